import itertools
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from benchweave.functions import names as N
from benchweave.functions import paths as P
from benchweave.functions import text as X
from benchweave.functions import vectors as V
from benchweave.functions.hashing import hash_uniform, hex_prefix, stable_hash


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expr.alias("y")).orderBy("i").collect()]


def test_names(spark):
    raw = ["  Albizia_zyia . ", "KHAYA  Ivorensis", "Ｋｈａｙａ　ﬁlix", "", "single", None, "a b", ". _x_ ."]
    assert column(spark, raw, N.sanitize_name("x")) == ["Albizia zyia", "KHAYA Ivorensis", "Khaya filix", "", "single", "", "a b", "x"]
    assert column(spark, raw, N.canonical_name("x")) == ["Albizia zyia", "Khaya ivorensis", "Khaya filix", "", "Single", "", "A b", "X"]
    assert column(spark, raw, N.genus_of("x"))[:3] == ["Albizia", "Khaya", "Khaya"]
    assert column(spark, ["A_b  C. "], N.name_key_loose("x")) == ["a b c"]


def test_compatibility_form_equals_unicodedata(spark):
    texts = ["é", "é", "ﬃ", "①", "ｶﾞ", "plain", "㎏ Å"]
    assert column(spark, texts, N.compatibility_form("x")) == [unicodedata.normalize("NFKC", t) for t in texts]


def test_tokens_and_ids(spark):
    assert column(spark, [" P1, ,P2,P1", "", None], N.tokens("x")) == [["P1", "P2"], [], []]
    assert column(spark, ["a| |b|a"], N.pipe_list("x")) == [["a", "b", "a"]]
    assert column(spark, [" NA ", "n/a", "Unknown", " 7 ", None], N.optional_id("x")) == ["", "", "", "7", ""]


def test_paths(spark):
    paths = ["Phase1/33. Bagassa guianensis/3. inner/AB12_3.png", "x/ 7 .  Khaya_ivorensis . /a/b/y.x.JPG", "12. ./z.png", "Khaya/x.png"]
    assert column(spark, paths, P.entity_folder("x")) == ["33. Bagassa guianensis", " 7 .  Khaya_ivorensis . ", None, None]
    assert column(spark, paths, P.entity_label(P.entity_folder("x"))) == ["Bagassa guianensis", "Khaya ivorensis", "", ""]
    assert column(spark, paths, P.specimen_of("x", P.entity_folder("x"))) == ["3. inner", "a/b", "z", "x"]
    assert column(spark, ["33. A b/AB12_3.png", "33. A b/x.png"], P.specimen_of("x", P.entity_folder("x"))) == ["AB12", "x"]
    assert column(spark, paths, P.phase_of("x", F.lit("other"))) == ["Phase1", "other", "other", "other"]
    assert column(spark, paths, P.source_id("d", "x"))[1] == "d:x/ 7 .  Khaya_ivorensis . /a/b/y.x"
    assert column(spark, ["a/b.PNG", "a/b", "a/.png", "b.txt"], P.is_image("x")) == [True, False, False, False]


def test_group_key_kinds(spark):
    rows = [("d", "macro", "S", "s1", "q", "p"), ("d", "macro", "S", "NA", "q", "p"), ("d", "macro", "S", "", "none", "p")]
    df = spark.createDataFrame(rows, "dataset_name string, modality string, species string, specimen_id string, source_id string, image_path string")
    keys = [r[0] for r in df.select(P.group_key()).collect()]
    assert keys == ["d|macro|S|specimen:s1", "d|macro|S|source:q", "d|macro|S|source:p"]


def test_text(spark):
    assert column(spark, [None, 0, 1023, 1152, 1024**2, 5 * 1024**5], X.format_bytes("x"), "bigint") == ["n/a", "0.00 B", "1023.00 B", "1.12 KB", "1.00 MB", "5120.00 TB"]
    assert column(spark, [" 1.5 ", "", "x", "1e3", "2d", None], X.try_float("x")) == [1.5, None, None, 1000.0, None, None]
    assert column(spark, [0.125, None], X.percent_text("x"), "double") == ["12.5", "n/a"]
    w, h = X.fit_long_side("x", F.lit(1280 * 2), 1280)
    assert column(spark, [5, 1, 0, 2560], w, "bigint") == [2, 1, None, 1280]  # 2.5 and 0.5 round to even, at least 1


def test_specimen_by_text_steps(spark):
    """Odd paths and folders as by parts; no array step, which would be computed anew at each use of its result."""

    def brute(path, folder):
        parts = [p for p in path.split("/") if p]
        below = parts[parts.index(folder) + 1 : -1] if folder in parts[:-1] else []
        name = path.split("/")[-1]
        name = re.sub(r"^(.+)\.[^.]+$", r"\1", name)
        return "/".join(below) or re.sub(r"^([A-Za-z]{1,8}\d{2,}[A-Za-z0-9-]*)[_-].*$", r"\1", name)

    pieces = ["a", "", "12. G x", "a.b", "AB12_c", ".hid", "x.", "é", "AB12-3_x.png", ".."]
    rows = [("/".join(p), f) for n in (1, 2, 3) for p in itertools.product(pieces, repeat=n) for f in ("a", "", "12. G x", "a/a", None)]
    df = spark.createDataFrame(rows, "x string, f string").select("x", "f", P.specimen_of("x", F.col("f")).alias("s"))
    assert all(r["s"] == brute(r["x"], r["f"]) for r in df.collect())
    assert "slice(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_hashes(spark):
    import hashlib

    digest = hashlib.sha256(b"42|a|b").hexdigest()
    df = spark.range(1).select(stable_hash(42, F.lit("a"), F.lit("b")).alias("h"), hash_uniform(42, F.lit("a"), F.lit("b")).alias("u"))
    row = df.first()
    assert row["h"] == digest[:16] and row["u"] == (int(digest[:13], 16) + 0.5) / 2**52
    assert spark.range(1).select(hex_prefix(F.lit("ff0"), 2)).first()[0] == 255


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    rows = df.select(V.l2_normalize("a").alias("n"), V.cosine("a", "b").alias("c")).collect()
    assert rows[0]["n"] == [0.6, 0.8] and abs(rows[0]["c"] - 0.96) < 1e-12
    assert rows[1]["n"] == [0.0, 0.0] and rows[1]["c"] == 0.0
    label, confidence = V.softmax_top("x")
    assert column(spark, [[1.0, 1.0, 0.0]], label, "array<double>") == [0]  # first of equals
    with pytest.raises(ValueError):
        V.feature_vector("other")
    pooled = df.select(F.when(F.col("a")[0] > 0, F.col("a")).alias("pooled_feature"))
    assert pooled.where("pooled_feature is not null").select(V.feature_vector("pooled").alias("v")).first()["v"] == [3.0, 4.0]
    with pytest.raises(Exception, match="a row has no pooled_feature"):
        pooled.select(V.feature_vector("pooled").alias("v")).collect()
