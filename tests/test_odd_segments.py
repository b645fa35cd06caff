import shutil

import pyarrow as pa
import pyarrow.parquet as pq

from folioscan.queries import load
from tests.oracle import compare

D = "/root/testdata/sf0.001"


def _moved(tmp_path, move):
    """The tables of ``D`` with every vector changed by ``move``."""
    shutil.copytree(D, tmp_path / "in", copy_function=shutil.copyfile)
    path = tmp_path / "in" / "embeddings.parquet"
    t = pq.read_table(path)
    vectors = [move(i, list(v)) for i, v in enumerate(t.column("embedding").to_pylist())]
    at = t.schema.get_field_index("embedding")
    pq.write_table(t.set_column(at, t.schema.field(at), pa.array(vectors, t.schema.field(at).type)), path)
    return str(tmp_path / "in")


def test_arrowheads_of_no_extent_match_their_sql(spark, tmp_path):
    queries, sql = load()
    d = _moved(tmp_path, lambda i, v: [*v[:2], *v[:2], *v[4:]] if i % 9 == 0 else v)
    compare(queries["p17_arrowheads"](spark, d), sql["p17_arrowheads"], d)


def test_bubbles_count_lines_that_end_on_the_rim_of_the_ring(spark, tmp_path):
    # from (0.3, 0.3) the ends at 12.3, 13.5, 14.7 ... lie on 1.2 times a radius, as near as doubles come
    queries, sql = load()
    d = _moved(tmp_path, lambda i, v: [0.00305, 0.00305, (3 + 12 * (10 + i % 31)) / 1000 + 0.00005, 0.00305, *v[4:]])
    compare(queries["x4_bubbles"](spark, d), sql["x4_bubbles"], d)
