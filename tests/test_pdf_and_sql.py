"""PDF round trips and SQL registration."""

from pyspark.sql import functions as F

from loomtext.functions import pdf
from loomtext.sql import register

PAGES = [{"width": 210.0, "height": 297.0, "items": [{"kind": "text", "text": "Hello (world) \\ é", "x": 10.0, "y": 280.0, "size": 12.0}, {"kind": "text", "text": "second", "x": 10.0, "y": 270.0}, {"kind": "line", "x": 0.0, "y": 0.0, "x2": 5.0, "y2": 5.0}, {"kind": "rect", "x": 0.0, "y": 0.0, "x2": 5.0, "y2": 5.0}]}, {"width": 100.0, "height": 100.0, "items": [{"kind": "text", "text": "two", "x": 1.0, "y": 1.0}]}]


def test_pdf_round_trip(spark):
    data = pdf.pdf_bytes(PAGES, {"Title": "T (1)"})
    out = pdf.read_pdf(data)
    assert out == {"text": "Hello (world) \\ é\nsecond\ftwo", "numpages": 2, "info": {"Title": "T (1)"}, "version": "1.4"}
    assert pdf.read_pdf(data, 1)["text"] == "Hello (world) \\ é\nsecond" and pdf.read_pdf(b"no pdf") == {"text": "", "numpages": 0, "info": {}, "version": "unknown"}
    df = spark.createDataFrame([(bytearray(data),), (None,)], "x binary")
    rows = df.select(pdf.parse(F.col("x"), 1).alias("p")).collect()
    assert rows[0].p.numpages == 2 and rows[1].p is None


def test_functions_in_sql(spark):
    names = register(spark)
    assert len(names) == len(set(names))
    r = spark.sql("SELECT lt_stem('running', 'english') s, lt_slugify('Ärger über', '-') g, lt_sentences('Ab cd. Cd e') x, lt_xxh32(CAST('' AS BINARY)) h, lt_sanitize_html('<b>x</b><script>1</script>') c, lt_stem(NULL, 'english') n").first()
    assert r.s == "run" and r.g == "arger-uber" and r.x == ["Ab cd.", "Cd e"] and r.h == 0x02CC5D05 and r.c == "<b>x</b>" and r.n is None
