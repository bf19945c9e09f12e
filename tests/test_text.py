"""Text functions against Python's own."""

from pyspark.sql import functions as F

from stratadoc.functions import text as T

#: Letters with case, ligatures and full-width forms.
RANGES = [(0x20, 0x590), (0x1E00, 0x2000), (0x2C00, 0x2D30), (0xFB00, 0xFB18), (0xFF21, 0xFF5B), (0x10400, 0x10450)]


def test_case_folding(spark):
    chars = [chr(c) for low, high in RANGES for c in range(low, high) if chr(c).isalpha()]
    texts = [*chars, "ΟΔΟΣ ΣΑΣ", "Straße ﬁn ſ", "İstanbul", "", None, "weiß ẞ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.norm_text(F.col("t")).alias("n")).collect()
    wrong = [(r.t, r.n) for r in rows if r.n != (None if r.t is None else "".join(r.t.split()).casefold())]
    assert wrong == []
