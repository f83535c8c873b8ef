import uuid

from pyspark.sql import functions as F

from skein.functions import ids, metrics, text, vectors
from skein.operators.linking import lcs, token_sort_ratio


def one(spark, col, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'array<double>' if isinstance(v, list) else 'boolean' if isinstance(v, bool) else 'int'}" for n, v in values.items()))
    assert names
    return df.select(col.alias("x")).first()[0]


def test_key_tokens(spark):
    assert one(spark, text.key_tokens(F.col("a")), a="The Cat's 2 hats, and a rat!") == ["cat", "hats", "rat"]
    assert one(spark, text.key_tokens(F.col("a")), a=None) == []


def test_html(spark):
    assert one(spark, text.strip_html(F.col("a")), a="<p>a &amp;lt; b</p>\n <b>c</b>") == "a &lt; b c"
    assert one(spark, text.clean_book_text(F.col("a")), a="<style>x</style><p>a&amp;lt;b</p>&copy;\n\n\n\nd") == "a<b \n\nd"
    assert one(spark, text.clean_book_text(F.col("a")), a="a<script>1</style>2</script>b<STYLE\nx>y</STYLE>c&#x2019;d") == "a b c d"
    assert one(spark, text.body_of(F.col("a")), a="no body") == "no body"


def test_names(spark):
    assert one(spark, text.normalize_name(F.col("a")), a=" Ann’s ") == "Ann"
    assert one(spark, text.normalize_entity_text(F.col("a")), a="the King's men!?") == "King men"
    assert one(spark, text.is_noise(F.col("a")), a=" Everyone ") is True
    assert one(spark, text.slug(F.col("a")), a="Ann O'Neil of the very long house") == "ann_o_neil_of_the_ve"


def test_ids_match_the_standard(spark):
    for s in ("", "x", "héllo", "pathway:abc"):
        assert one(spark, ids.uuid5(F.col("a")), a=s) == str(uuid.uuid5(uuid.NAMESPACE_DNS, s))
    import hashlib

    want = int(hashlib.sha256(b"book.epub:3").hexdigest()[:14], 16) % (2**31 - 1)
    assert one(spark, ids.stable_doc_id(F.col("a"), F.lit(3)), a="book.epub") == want


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0, 5.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and got[1] == 0.0 and got[3] is None and abs(got[2] - 2 / (27**0.5 * 2**0.5)) < 1e-12


def test_decay(spark):
    assert abs(one(spark, vectors.decayed(F.col("a"), F.lit(2), F.lit(True)), a=1.0) - 0.405) < 1e-12


def test_recall_and_f1(spark):
    assert one(spark, metrics.token_recall(F.col("a"), F.col("b")), a="red fox", b="the red fox runs far away") == 0.4
    assert one(spark, metrics.token_recall(F.col("a"), F.col("b")), a="the", b="the") == 1.0
    assert one(spark, metrics.token_recall(F.col("a"), F.col("b")), a="x", b=None) == 0.0
    assert one(spark, metrics.token_f1(F.col("a"), F.col("b")), a="a b", b="b c") == 0.5


def test_run_score(spark):
    s = metrics.run_score(F.lit("tier1+tier2"), F.lit(0.5), F.lit(7), F.lit(2000), F.lit(9))
    assert one(spark, s, a=1) == 95.0


def test_factual_and_mentions(spark):
    assert one(spark, text.is_factual(F.col("a")), a="Who is Ann?") is True
    assert one(spark, text.is_factual(F.col("a")), a="Imagine who is Ann") is False
    assert one(spark, text.mention_count(F.col("a"), F.lit("ann")), a="Ann and ANN") == 2


def test_sort_ratio():
    assert lcs("abcde", "abxde") == 4
    assert token_sort_ratio("b a", "a b") == 100.0
    assert abs(token_sort_ratio("kitten", "sitten") - 2 * 5 / 12 * 100) < 1e-9
    assert token_sort_ratio(None, "") == 100.0
