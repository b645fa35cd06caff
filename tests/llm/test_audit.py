import numpy as np

from folioscan.llm import embeddup


def test_audit_sees_classes_whose_only_link_was_missed(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(360, 32))
    x[:60] = x[0] + 0.01 * x[:60]
    x[60:120] = x[120:180] + 0.01 * x[60:120]
    found = [(i, 59) for i in range(60)]
    classes = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "rep long, v array<double>, weight long")
    none = embeddup.audit(classes, spark.createDataFrame(found, "rep long, n long"), 32, 0.9)
    every = embeddup.audit(classes, spark.createDataFrame(found + [(i, 1) for i in range(60, 180)], "rep long, n long"), 32, 0.9)
    assert abs(none - 60 / 180) < 1e-9 and every == 1.0
