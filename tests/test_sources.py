import pytest

from folioscan import derive
from folioscan.sources import dxf
from folioscan.streaming import events as E

FILE = "\n".join(
    "0 SECTION 2 HEADER 9 $INSUNITS 70 6 0 ENDSEC 0 SECTION 2 BLOCKS 0 BLOCK 2 MARK 10 0 20 0 0 LINE 8 0 10 0 20 0 11 1 21 0 0 ENDBLK 0 ENDSEC "
    "0 SECTION 2 ENTITIES 0 LINE 5 A1 8 WALL 62 1 10 0 20 0 11 3 21 4 0 CIRCLE 8 HOLE 10 5 20 5 40 2 0 TEXT 8 NOTE 10 1 20 1 40 0.25 1 B-2 "
    "0 LWPOLYLINE 8 EDGE 70 1 10 0 20 0 10 4 20 0 10 4 20 3 0 INSERT 2 MARK 10 10 20 10 70 2 71 2 44 5 45 5 50 90 0 POLYLINE 8 OLD 70 0 0 VERTEX 10 1 20 1 0 VERTEX 10 2 20 2 0 SEQEND 0 ENDSEC 0 EOF".split()
)


def test_dxf_entities():
    rows = dxf.parse(FILE, "f")
    kinds = [r[4] for r in rows]
    assert kinds == ["line", "circle", "text", "polyline", "line", "line", "line", "line", "polyline"]
    assert rows[0][5] == "WALL" and rows[0][7:11] == (0.0, 0.0, 3.0, 4.0) and rows[0][-1] == "m"
    assert rows[1][7:11] == (3.0, 3.0, 7.0, 7.0) and rows[2][-4] == "B-2" and rows[3][13] is True
    # the second column of a grid insert turned by 90 degrees goes up
    assert rows[5][11] == pytest.approx([10.0, 10.0]) and rows[5][12] == pytest.approx([15.0, 16.0])


def test_dxf_source_and_files(spark, tmp_path):
    p = tmp_path / "a.dxf"
    p.write_text(FILE)
    spark.dataSource.register(dxf.DxfSource)
    assert spark.read.format("dxf").load(str(p)).count() == 9
    (tmp_path / "b.dxf").write_text("0\nSECTION\nbroken")
    got = dxf.entities_of_files(spark.read.format("binaryFile").load(str(tmp_path / "*.dxf")))
    assert got.count() == 9 and got.where("kind = 'text'").first()["content"] == "B-2"


def test_streams_give_what_batches_give(spark, tmp_path):
    e = derive.table(spark, "/root/testdata/sf0.001", "events")
    src = str(tmp_path / "in")
    e.repartition(3).write.parquet(src)
    stream = E.event_time(E.read_stream(spark, src, e.schema), "1 hour")
    q = E.tumbling(stream).writeStream.format("memory").queryName("tumbling_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.start, r.event_type): r.n for r in E.tumbling(e.withColumn("ts", e.ts.cast("timestamp"))).collect()}
    got = {(r.start, r.event_type): r.n for r in spark.sql("select * from tumbling_out").collect()}
    assert got == want


def test_sink_writes_each_batch_once(spark, tmp_path):
    e = derive.table(spark, "/root/testdata/sf0.001", "events")
    src = str(tmp_path / "in")
    e.repartition(2).write.parquet(src)
    for _ in range(2):
        q = E.to_table(E.read_stream(spark, src, e.schema), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.count()
