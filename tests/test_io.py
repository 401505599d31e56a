import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from benchweave.operators import custom, filters
from benchweave.sources import embeddings, files, sinks, tables
from benchweave.streaming import accumulators as S


def test_scan_and_tables(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("a/x.PNG", "a/b/y.tif", "a/z.txt"):
        (tmp_path / name).write_bytes(b"12345")
    got = {r["rel_path"]: r["bytes"] for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert got == {"a/x.PNG": 5, "a/b/y.tif": 5}
    (tmp_path / "_dir" / ".deep" / "sp ace %20").mkdir(parents=True)
    (tmp_path / "none").mkdir()
    hidden = ("_x.png", ".x.png", "_dir/x.png", "_dir/.deep/sp ace %20/empty.jpg")
    for name in hidden:
        (tmp_path / name).write_bytes(b"")
    (tmp_path / "a" / "loop").symlink_to(tmp_path)
    rows = files.scan_files(spark, f"file://{tmp_path}").collect()
    assert sorted(r["rel_path"] for r in rows) == sorted([*got, *hidden]) and all(r["path"] == f"{tmp_path}/{r['rel_path']}" for r in rows)
    assert files.scan_files(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        files.scan_files(spark, str(tmp_path / "missing"))
    csv = tmp_path / "t.csv"
    csv.write_text('﻿raw_name,target\n"Albizia ""q"", x",Khaya a\nAlbizia zyia,\nAlbizia zyia,Khaya b\nalbizia_zyia,Khaya c\n', encoding="utf-8")
    rows = tables.read_table(spark, str(csv)).collect()
    assert rows[0]["raw_name"] == 'Albizia "q", x' and rows[1]["target"] == ""
    from benchweave.operators.matching import correction_map

    fixes = {r["raw_key"]: r["corrected"] for r in correction_map(tables.load_corrections(spark, str(csv))).collect()}
    assert fixes["albizia zyia"] == "Khaya c" and fixes["bagassa guiamensis"] == "Bagassa guianensis"  # file over defaults, last wins
    plain = tmp_path / "plain.csv"
    plain.write_text('Kaya,"Khaya\nivorensis"\nAlbizia zyia,Albizia zygia,note\n', encoding="utf-8")
    found = tables.load_corrections(spark, str(plain), {}, headerless=True).orderBy("position").collect()
    assert [(r["raw_name"], r["corrected_name"]) for r in found] == [("Kaya", "Khaya\nivorensis"), ("Albizia zyia", "Albizia zygia")]
    with pytest.raises(ValueError):
        tables.load_corrections(spark, str(plain))
    with pytest.raises(ValueError):
        tables.correction_rows(spark.createDataFrame([("a",)], "other string"))
    with pytest.raises(ValueError):
        tables.require_columns(spark.range(1), ["id", "x"])


def test_later_rows_and_files_win(spark, tmp_path):
    from benchweave.operators.matching import correction_map

    (tmp_path / "c").mkdir()
    filler = "".join(f"name{i} x,Genus species\n" for i in range(2000))
    (tmp_path / "c" / "a.csv").write_text("raw_name,target\nkaya one,Khaya first\n" + filler + "kaya one,Khaya second\n")
    (tmp_path / "c" / "b.csv").write_text("raw_name,target\nkaya one,Khaya third\n")
    rows = tables.load_corrections(spark, str(tmp_path / "c"))
    assert {r["raw_key"]: r["corrected"] for r in correction_map(rows).collect()}["kaya one"] == "Khaya third"
    log = tmp_path / "log"
    log.mkdir()
    for name, n in (("a.csv", 500), ("b.csv", 1)):
        (log / name).write_text("processed_path\n" + "".join(f"{name}/{i}\n" for i in range(n)))
    got = [r["processed_path"] for r in tables.read_log(spark, str(log)).orderBy("position").collect()]
    assert got == [f"a.csv/{i}" for i in range(500)] + ["b.csv/0"]


def test_headers_prefer_alias_order():
    assert tables.pick_header(["species", "target", "typo"], tables.CORRECTION_TARGET_HEADERS) == "target"


def test_manifest_numbering(spark, tmp_path):
    df = spark.createDataFrame([(f"p{i}", "A|B" if i else "") for i in range(5)], "image_path string, taxonomy_suggestions string").coalesce(1)
    sinks.write_csv(df, str(tmp_path / "m"), ["image_path", "taxonomy_suggestions", "extra"])
    rows = tables.read_manifest(spark, str(tmp_path / "m"), numbered=True).orderBy("row_index").collect()
    assert [(r["row_index"], r["image_path"]) for r in rows] == [(i, f"p{i}") for i in range(5)]
    assert rows[0]["taxonomy_suggestions"] == [] and rows[1]["taxonomy_suggestions"] == ["A", "B"] and rows[0]["extra"] == ""


def test_embedding_shapes(spark, tmp_path):
    rows = [{"modality": "macro", "species": "A b", "image_path": "p", "embedding": [1.0, 2.0]}]
    (tmp_path / "list.json").write_text(json.dumps(rows))
    (tmp_path / "obj.json").write_text(json.dumps({"records": rows}))
    for name in ("list.json", "obj.json"):
        got = embeddings.read_records(spark, str(tmp_path / name)).collect()
        assert [r["embedding"] for r in got] == [[1.0, 2.0]]
    packed = spark.createDataFrame([([[1.0]], ["A b"], [[2.0], [3.0]], ["A b", "C d"])], "macro_emb array<array<double>>, macro_species array<string>, z_micro array<array<double>>, micro_labels array<string>")
    long = sorted((r["id"], r["species"]) for r in embeddings.from_parallel_arrays(packed).collect())
    assert long == [("macro:0", "A b"), ("micro:0", "A b"), ("micro:1", "C d")]
    broken = spark.createDataFrame([([[1.0]], ["A", "B"], [[2.0]], ["A"])], packed.schema)
    with pytest.raises(Exception, match="differ in length"):
        embeddings.from_parallel_arrays(broken).collect()
    wide = spark.createDataFrame([("macro", "S", "1.5", "2")], "modality string, label string, c0 string, c1 string")
    row = embeddings.from_wide(wide).first()
    assert row["species"] == "S" and row["embedding"] == [1.5, 2.0]


@pytest.fixture
def small_splits(spark):
    """Files fall into many pieces, so that quotes and records cross them."""
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "50"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def hostile_text(rng, letters, most):
    return "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))


def test_split_csv(spark, tmp_path, small_splits):
    """Pieces of files give the records and the order of a reader that goes through each file as a whole."""
    rng = random.Random(2)
    folder = tmp_path / "big"
    folder.mkdir()
    want = []
    for f, end in enumerate(["\n", "\r\n"]):
        with open(folder / f"{f}.csv", "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator=end)
            writer.writerow(["a", "b,c", "d"])
            for i in range(150):
                row = [f"{f}-{i}", hostile_text(rng, 'x",\n é', 40), "long " * 300 + '"\n"' if i == 70 else hostile_text(rng, "y", 5)]
                writer.writerow(row)
                want.append(tuple(row))
    got = tables.read_split_table(spark, str(folder))
    assert spark.read.option("lineSep", "\n").text(str(folder)).rdd.getNumPartitions() > 8
    rows = sorted(got.collect(), key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(300))
    assert [tuple(r[:3]) for r in rows] == want
    (tmp_path / "odd.csv").write_text('\ufeffk,v\n\n1,a"b\n2,"x\n\ny"\n   \n3,\n4,it"s, more"\n')
    odd = sorted(tuple(r) for r in tables.read_split_table(spark, str(tmp_path / "odd.csv"), ["k", "v"]).drop("position").collect())
    assert odd[:3] == [("1", 'a"b'), ("2", "x\n\ny"), ("3", "")] and len(odd) == 4
    with pytest.raises(ValueError):
        tables.read_split_table(spark, str(tmp_path / "odd.csv"), ["k"])


def test_split_json_lists(spark, tmp_path, small_splits):
    rng = random.Random(3)
    records = []
    for i in range(200):
        r = {"modality": rng.choice(["macro", "micro"]), "species": hostile_text(rng, 'ab{}[],"\\\n:é', 30), "embedding": [float(i)] * rng.randint(0, 30)}
        if i % 3:
            r["image_path"] = f"p{i}"
        if i % 5 == 0:
            r["extra"] = {"deep": [{"x": "}"}, {}], "more": "{"}
        records.append(r)
    forms = {
        "list.json": json.dumps(records),
        "pretty.json": json.dumps(records, indent=2, ensure_ascii=False) + "\n",
        "object.json": json.dumps({"records": records, "after": {"records": [{"modality": "no"}]}}),
        "spaced.json": " \n" + json.dumps({"records": records}, indent=1),
    }
    seen = {}
    want = []
    for r in records:
        n = seen.setdefault(r["modality"], [0])
        want.append((r.get("image_path", f"{r['modality']}:{n[0]}"), r["modality"], r["species"], tuple(r["embedding"])))
        n[0] += 1
    for name, text in forms.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
        rows = embeddings.read_records(spark, str(tmp_path / name)).collect()
        assert sorted((r["id"], r["modality"], r["species"], tuple(r["embedding"])) for r in rows) == sorted(want), name
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in records))
    rows = embeddings.read_records(spark, str(tmp_path / "lines.json"), lines=True).collect()
    assert sorted(r["id"] for r in rows) == sorted(w[0] for w in want)
    (tmp_path / "empty.json").write_text("[]")
    assert embeddings.read_records(spark, str(tmp_path / "empty.json")).count() == 0
    (tmp_path / "other.json").write_text('{"a": [1]}')
    with pytest.raises(Exception, match="neither a list"):
        embeddings.read_records(spark, str(tmp_path / "other.json")).collect()


def test_array_rows_keep_ids_apart(spark):
    row = ([[1.0], [2.0]], ["A b", "A b"], [[3.0]], ["C d"])
    packed = spark.createDataFrame([row, row], "macro_emb array<array<double>>, macro_species array<string>, z_micro array<array<double>>, micro_labels array<string>")
    ids = [r["id"] for r in embeddings.from_parallel_arrays(packed).collect()]
    assert len(ids) == len(set(ids)) == 6 and all(i.startswith(("macro:", "micro:")) for i in ids)


def test_json_and_filters(spark):
    text = sinks.json_text(spark.createDataFrame([(1, None, "x")], "b int, c string, a string")).first()[0]
    assert text == '{"a":"x","b":1,"c":null}'
    assert filters.wanted_modalities("both") == ("macro", "micro") and filters.wanted_modalities(mode="micro_classification") == ("micro",)
    for bad in (("other", "joint_alignment"), ("micro", "macro_classification"), (None, "x")):
        with pytest.raises(ValueError):
            filters.wanted_modalities(*bad)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"r{i % 3}", i, "s", "p", None, {"acc": float((i * 7) % 10)}) for i in range(30)], S.HISTORY_SCHEMA)
    for part in range(3):
        sinks.append_records(rows.where(F.col("epoch") % 3 == part), str(tmp_path / "h"))
    stream = S.history_stream(spark, str(tmp_path / "h"), 1).withColumn("metric", F.col("val_metrics")["acc"])
    batch = S.best_epochs(rows.withColumn("metric", F.col("val_metrics")["acc"]))
    out = str(tmp_path / "out")
    assert sorted(S.drain(S.best_epochs(stream), out).collect()) == sorted(batch.collect())
    more = spark.createDataFrame([("r0", 99, "s", "p", None, {"acc": 50.0})], S.HISTORY_SCHEMA)
    sinks.append_records(more, str(tmp_path / "h"))
    stream = S.history_stream(spark, str(tmp_path / "h"), 1).withColumn("metric", F.col("val_metrics")["acc"])
    resumed = {r["run"]: r for r in S.drain(S.best_epochs(stream), out).collect()}
    assert resumed["r0"]["best_epoch"] == 99 and resumed["r0"]["epochs"] == 11 and resumed["r1"]["epochs"] == 10


def test_transform_needs_every_modality(spark):
    df = spark.createDataFrame([("a", "macro"), ("b", "micro")], "id string, modality string")
    assert custom.map_items(df, lambda b: b, df.schema).count() == 2
    with pytest.raises(Exception, match="no transform"):
        custom.map_items(df, {"macro": lambda b: b}, df.schema).collect()


def test_json_history_grows(spark, tmp_path):
    """After every appended file, in any order of epochs, the drained stream equals the batch result over all files."""
    import json

    from benchweave.streaming import accumulators as S

    folder = tmp_path / "history"
    folder.mkdir()
    spells = [
        [("a", 3, 0.5), ("b", 1, None), ("a", 1, 0.2)],
        [("a", 2, 0.5), ("b", 2, 0.1), ("c", 9, float("nan"))],
        [("b", 0, 0.1), ("a", 7, 0.4), ("c", 1, 0.3)],
    ]
    best: dict = {}
    for i, spell in enumerate(spells):
        lines = [{"run": r, "epoch": e, "stage_name": "s", "val_metrics": {} if v is None else {"score": v, "other": 1.0}} for r, e, v in spell]
        (folder / f"part{i}.json").write_text("\n".join(map(json.dumps, lines)) + "\n")
        for r, e, v in spell:
            if v is not None and v == v:
                top, epochs = best.get(r, ((-1.0, 0), 0))
                best[r] = (max(top, (v, -e)), epochs + 1)
        rows = S.drain(S.best_epochs(S.metric_rows(S.history_stream(spark, str(folder)), "score")), str(tmp_path / "out")).collect()
        assert {r.run: (r.best_metric, r.best_epoch, r.epochs) for r in rows} == {r: (v, -e, n) for r, ((v, e), n) in best.items()}


def test_written_files_are_bounded_and_manifests_packed(spark, tmp_path):
    """All records are written, over files that one task can read; split reports come from the written rows."""
    rows = spark.range(120_000).coalesce(1).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 3 == 0, "val").otherwise("train").alias("split"), F.lit('a "b"\n').alias("t"))
    sinks.write_csv(rows, str(tmp_path / "flat"), ["k", "t"])
    assert len(list((tmp_path / "flat").glob("*.csv"))) == 3
    assert tables.read_table(spark, str(tmp_path / "flat"), ["k", "t"]).distinct().count() == 120_000
    count = lambda written: written.groupBy("split", "t").agg(F.count(F.lit(1)).alias("n"))
    paths = sinks.write_splits(rows, "P3", str(tmp_path / "s"), count, count)
    assert list((tmp_path / "s" / "splits" / "protocol=P3" / "split=val").glob("*.csv.gz"))
    got = {(r["split"], r["t"], int(r["n"])) for r in tables.read_table(spark, f"{paths['class_counts']}/protocol=P3").collect()}
    assert got == {("val", 'a "b"\n', 40_000), ("train", 'a "b"\n', 80_000)}


def test_long_tables_are_written_packed(spark, tmp_path):
    """src_csv keeps its manifest as gzip files; quotes, blanks and line breaks come back as they were."""
    from __spark_entry__ import queries

    names = queries()["src_csv"](spark, "/root/testdata/sf0.001").inputFiles()
    assert names and all(n.endswith(".csv.gz") for n in names)
    rng = random.Random(5)
    want = [(str(i), hostile_text(rng, 'x",\n é', 40)) for i in range(500)]
    sinks.write_csv(spark.createDataFrame(want, "k string, t string"), str(tmp_path / "p"), ["k", "t"], packed=True)
    assert sorted(map(tuple, tables.read_table(spark, str(tmp_path / "p"), ["k", "t"]).collect())) == sorted(want)
