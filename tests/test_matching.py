import difflib
import random

import pytest
from pyspark.sql import functions as F

from benchweave.operators import closeness, matching, reports
from benchweave.operators import manifest as M
from benchweave.operators.ranking import row_numbers
from benchweave.schemas import MANIFEST_COLUMNS

CAT = "species string, genus string, family string, group string, overlap_type string, protocol_usage string, group_order string, position bigint"
ROWS = [
    ("Khaya ivorensis", "Khaya", "F1", "A", "x", "P1,P2,P3", "2", 0),
    ("khaya_grandis", "Khaya", "F2", "B", "y", "P2,P3", "1", 1),
    ("Albizia zygia", "Albizia", "Fab", "A", "x", "P1,P2,P3", "", 2),
    ("ALBIZIA ZYGIA", "Albizia", "Fab", "C", "z", "P3", "3", 3),
    ("Hevea brasiliensis", "", "", "C", "z", "P3", "4", 4),
]


def cat(spark):
    return matching.prepare_catalogue(spark.createDataFrame(ROWS, CAT))


def test_catalogue_keys_and_genus_table(spark):
    last = {r["species_key"]: r["protocol_group"] for r in matching.by_key(cat(spark)).collect()}
    first = {r["species_key"]: r["protocol_group"] for r in matching.by_key(cat(spark), keep="first").collect()}
    assert last["albizia zygia"] == "C" and first["albizia zygia"] == "A"
    genera = {r["genus_key"]: (r["genus_family"], r["genus_names"]) for r in matching.genus_table(cat(spark)).collect()}
    assert genera["khaya"] == ("", "Khaya grandis|Khaya ivorensis")  # two families: none; order by group_order
    assert genera["hevea"] == ("", "Hevea brasiliensis") and genera["albizia"][0] == "Fab"


def test_cascade_statuses(spark):
    names = spark.createDataFrame([("khaya_IVORENSIS", ""), ("Albizia zyia", ""), ("odd", "Khaya grandis"), ("Khaya ivorensi", ""), ("Khaya zzzz", ""), ("Nothing here", "")], "raw_name string, given string")
    fixes = spark.createDataFrame([("Albizia zyia", "Albizia zygia")], "raw_name string, corrected_name string")
    got = {r["raw_name"]: r for r in matching.match_names(names, cat(spark), fixes, "raw_name", "given").collect()}
    assert got["khaya_IVORENSIS"]["taxonomy_match_status"] == "exact_species_match"
    assert got["Albizia zyia"]["taxonomy_match_status"] == "exact_species_match_via_normalization"
    assert got["odd"]["matched_species_name"] == "Khaya grandis"  # the given name beats everything
    assert got["Khaya ivorensi"]["taxonomy_suggestions"] == "Khaya ivorensis"
    assert got["Nothing here"]["taxonomy_match_status"] == "unmatched"
    loose = {r["raw_name"]: r for r in matching.match_names(names, cat(spark), fixes, "raw_name", "given", genus_fallback=True).collect()}
    row = loose["Khaya zzzz"]
    assert (row["taxonomy_match_status"], row["protocol_group"], row["protocol_usage"]) == ("genus_match_only", "B", "P2,P3")
    assert row["taxonomy_suggestions"] == "Khaya grandis|Khaya ivorensis"


def brute_suggestions(name, species, genera):
    out = []
    for pool, cutoff in ((species, 0.88), ([s for s in species if genera[s] == name.split(" ")[0]], 0.72)):
        for hit in difflib.get_close_matches(name, pool, n=3, cutoff=cutoff):
            if hit not in out:
                out.append(hit)
    return "|".join(out[:3])


def test_suggestions_equal_brute_force(spark):
    rng = random.Random(3)
    genera = ["Khaya", "Albizia", "Hevea"]
    species = sorted({f"{rng.choice(genera)} {''.join(rng.choice('abcde') for _ in range(7))}" for _ in range(60)})
    names = sorted({s[:i] + rng.choice("abxy") + s[i + 1 :] for s in species for i in (7, 9, 11)})
    catalogue = spark.createDataFrame([(s, s.split(" ")[0].lower()) for s in species], "species string, genus_key string")
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: r["suggestions"] for r in matching.suggest(df, catalogue, "name").collect()}
    want = {n: brute_suggestions(n, species, {s: s.split(" ")[0] for s in species}) for n in names}
    assert got == {n: w for n, w in want.items() if w}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def brute_close(name, records, score):
    """Three best of all records at 0.88, then of the genus at 0.72, equal scores from the last name, no name twice."""
    out = []
    genus = [s for s, g in records if g == name.split(" ")[0].lower()]
    for pool, cutoff in (([s for s, _ in records], 0.88), (genus, 0.72)):
        scored = sorted(((score(s, name), s) for s in pool), reverse=True)
        for value, hit in [x for x in scored if x[0] >= cutoff][:3]:
            if hit not in out:
                out.append(hit)
    return "|".join(out[:3])


def random_names(seed):
    """Records and names of many lengths: repeated records, odd genus spellings, one word, non-Latin letters, short texts."""
    rng = random.Random(seed)
    genera = ["Khaya", "Albizia", "Hevea", "Ab", "Öd"]
    word = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    species = [f"{rng.choice(genera)} {word(rng.randint(1, 12))}" for _ in range(120)]
    records = [(s, s.split(" ")[0].lower()) for s in species]
    records += records[:10] + [("KHAYA abcab", "khaya"), ("khaya bcabca", "khaya"), ("Kaya abcabcd", "khaya"), ("Hevea", "hevea"), ("a", "a"), ("ab", "ab")]
    names = set()
    for s in [s for s, _ in records]:
        for _ in range(3):
            t = s
            for _ in range(rng.randint(0, 5)):
                i = rng.randrange(len(t) + 1)
                t = rng.choice([t[:i] + rng.choice("abx ") + t[i:], t[:i] + t[i + 1 :], t[: max(i - 1, 0)] + rng.choice("abx") + t[i:]])
            names.add(t)
    return records, sorted(names | {"", "a", "Khaya", "KHAYA abcab", "khaya abcab", "Albizia " + "a" * 200})


@pytest.mark.parametrize("scorer", ["levenshtein", "gestalt"])
def test_signature_join_loses_nothing(spark, scorer):
    def edit_score(candidate, name):
        return 1.0 - edits(candidate, name) / max(len(candidate), len(name), 1)

    score = edit_score if scorer == "levenshtein" else lambda c, n: difflib.SequenceMatcher(None, c, n).ratio()
    records, names = random_names(4)
    catalogue = spark.createDataFrame(records, "species string, genus_key string")
    df = spark.createDataFrame([(n,) for n in [*names, None]], "name string")
    got = {r["name"]: r["suggestions"] for r in matching.suggest(df, catalogue, "name", scorer).collect()}
    want = {n: brute_close(n, records, score) for n in names}
    assert got == {n: w for n, w in want.items() if w}


@pytest.mark.parametrize("cutoff", [0.72, 0.88])
def test_segments_meet(spark, cutoff):
    """Every pair within the cutoff shares a segment entry, at all lengths, with and without a common beginning."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 18))) for _ in range(150)]
    for head in ("", "xy "):
        rows = sorted({head + t for t in texts})
        side = spark.createDataFrame([(r, "k", r[len(head) :], len(head), cutoff) for r in rows], "n string, _scope string, _text string, _pad int, _cutoff double")
        pairs = closeness.close_pairs(side, side.withColumnRenamed("n", "c"), closeness.Measure(), ["n", "c"])
        got = {(r["n"], r["r_c"]) for r in pairs.collect()}
        assert got == {(a, b) for a in rows for b in rows if 1 - edits(a, b) / max(len(a), len(b)) >= cutoff}


def test_cutoffs():
    with pytest.raises(ValueError):
        closeness.Measure().check(0.5)
    with pytest.raises(ValueError):
        closeness.Measure(overlap=True).check(0.6)


def test_raw_beats_corrected_and_first_record_wins(spark):
    names = spark.createDataFrame([("albizia zygia",), ("Albizia zyia",), ("Albizia none",), ("",)], "raw_name string")
    fixes = spark.createDataFrame([("albizia zygia", "Hevea brasiliensis"), ("Albizia zyia", "Albizia zygia")], "raw_name string, corrected_name string")
    got = {r["raw_name"]: (r["taxonomy_match_status"], r["protocol_group"]) for r in matching.annotate_raw_first(names, cat(spark), fixes).collect()}
    assert got == {"albizia zygia": ("matched_raw", "A"), "Albizia zyia": ("matched_corrected", "A"), "Albizia none": ("not_in_catalogue", ""), "": ("missing_species_folder", "")}


def test_manifests(spark):
    files = spark.createDataFrame([("Phase1/1. Khaya ivorensis/5/a.png",), ("misc/Albizia zyia/b.png",), ("misc/2. Odd/c.png",)], "rel_path string").withColumn("path", F.concat(F.lit("/r/"), "rel_path"))
    log = spark.createDataFrame([("/r/misc/2. Odd/c.png", "Phase2", "", "Hevea brasiliensis"), ("/r/misc/2. Odd/c.png", "Phase9", "", "Khaya grandis")], "processed_path string, phase string, raw_species_name string, corrected_species_name string")
    log = M.normalize_log(log.withColumn("position", F.monotonically_increasing_id()).coalesce(1), "/r")
    fixes = spark.createDataFrame([("Albizia zyia", "Albizia zygia")], "raw_name string, corrected_name string")
    out = M.macro_manifest(files, cat(spark), fixes, log, root="/r")
    assert out.columns == MANIFEST_COLUMNS
    rows = {r["image_rel_path"]: r for r in out.collect()}
    assert rows["Phase1/1. Khaya ivorensis/5/a.png"]["specimen_id"] == "5" and rows["Phase1/1. Khaya ivorensis/5/a.png"]["phase"] == "Phase1"
    assert rows["misc/Albizia zyia/b.png"]["species"] == "Albizia zygia"
    logged = rows["misc/2. Odd/c.png"]
    assert (logged["species"], logged["phase"]) == ("Khaya grandis", "Phase9")  # the last log entry of a path
    micro = M.micro_manifest(files.select(F.lit("Khaya other/1/x.tif").alias("rel_path")).distinct(), cat(spark)).first()
    assert micro["taxonomy_match_status"] == "genus_match_only" and micro["specimen_id"] == "1" and micro["phase"] == ""


def test_collision_names(spark):
    files = spark.createDataFrame([("d/a.png",), ("d/a.jpg",), ("d/A.png",), ("d/a.PNG",), ("d/b.tif",)], "rel_path string")
    got = {r["rel_path"]: r["output_path"] for r in M.output_names(files).collect()}
    assert got == {"d/b.tif": "d/b.jpg", "d/A.png": "d/A.jpg", "d/a.jpg": "d/a__from_jpg.jpg", "d/a.PNG": "d/a__from_png.jpg", "d/a.png": "d/a__from_png__dup2.jpg"}


def test_output_names_order_only_shared_names(spark, monkeypatch):
    """Files whose name is their own are not numbered, and no file is lost or named twice."""
    asked = []
    monkeypatch.setattr(M, "row_numbers", lambda df, *a, **o: asked.append(df.count()) or row_numbers(df, *a, **o))
    paths = [f"d/{i}.png" for i in range(40)] + [f"e/x.{e}" for e in ("png", "PNG", "Png", "tif")] + ["e/x__from_tif.gif"]
    files = spark.createDataFrame([(p,) for p in paths], "rel_path string")
    got = {r["rel_path"]: r["output_path"] for r in M.output_names(files).collect()}
    assert asked == [5] and set(got) == set(paths) and len(set(got.values())) == len(paths)
    assert [got[p] for p in paths[40:]] == ["e/x__from_png__dup3.jpg", "e/x__from_png.jpg", "e/x__from_png__dup2.jpg", "e/x__from_tif.jpg", "e/x__from_tif__dup2.jpg"]
    assert got["d/7.png"] == "d/7.jpg"


def test_uncertain_keeps_rows_with_suggestions(spark):
    base = {c: "" for c in MANIFEST_COLUMNS}
    rows = [{**base, "taxonomy_match_status": "exact_species_match", "taxonomy_suggestions": "A b"}, {**base, "taxonomy_match_status": "unmatched"}, {**base, "taxonomy_match_status": "genus_match_only"}]
    got = reports.uncertain_matches(spark.createDataFrame(rows)).collect()
    assert sorted(r["taxonomy_match_status"] for r in got) == ["exact_species_match", "genus_match_only"]


def test_last_correction_wins_in_the_raw_first_matcher(spark):
    names = spark.createDataFrame([("kaya",)], "raw_name string")
    fixes = spark.createDataFrame([("kaya", "Zzz wrong", 1), ("kaya", "Khaya ivorensis", 2)], "raw_name string, corrected_name string, position long")
    got = matching.annotate_raw_first(names, cat(spark), fixes).first()
    assert got["corrected_species_name"] == "Khaya ivorensis"
