"""The engine's operators: golden tables, properties, and the sources and sinks."""

from __future__ import annotations

import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from verdigris.functions import provider as P
from verdigris.functions import text as X
from verdigris.operators import accuracy, hamming, ocr, pdq
from verdigris.operators import validate as V
from verdigris.operators.decision import decide
from verdigris.operators.dictionary import Term, banned_violation, has_political_term
from verdigris.operators.username import local_violation, username_violation
from verdigris.plans import moderation
from verdigris.plans.queries import blocked_table
from verdigris.session import MediaSettings
from verdigris.sources import cases, dictionaries, hashes, images
from verdigris.streaming.decisions import run_batches, store_hashes

TERMS = dictionaries.parse_banned(["# test terms", "", "VULGAR|reject alpha", "SEXUAL|reject beta", "IMPERSONATION|reserved account"])


def column(spark, values, body, kind="string"):
    """The results of a Column function for the values."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", body(F.col("v")).alias("x")).orderBy("i").collect()]


# Text and dictionaries


def test_banned_terms(spark):
    texts = ["please REJECT   alpha now", "reject-beta", "r.e.j.e.c.t alpha", "rejectalpha", "preject alpha", "reject\nalpha", "reject alpha", "rеject bеta", "ｒｅｊｅｃｔ ａｌｐｈａ", "r3j3ct @lph@", "reserved account reject alpha", "", None, " "]
    want = ["VULGAR", "SEXUAL", "VULGAR", "NONE", "NONE", "NONE", "VULGAR", "SEXUAL", "VULGAR", "VULGAR", "VULGAR", "NONE", "NONE", "NONE"]
    assert column(spark, texts, lambda c: banned_violation(c, TERMS)) == want


def test_first_term_in_order_wins_and_masks(spark):
    terms = [Term(1, "IMPERSONATION", "boss"), Term(2, "VULGAR", "scum")]
    assert column(spark, ["boss scum", "scum"], lambda c: local_violation(F.lit("COMMENT"), c, terms)) == ["NONE", "VULGAR"]
    assert column(spark, ["boss scum"], lambda c: local_violation(F.lit("POST"), c, terms)) == ["NONE"]


def test_political_terms(spark):
    terms = dictionaries.political_terms()
    assert len(terms) == 106
    assert column(spark, ["The G0vernment fell", "governments", "ruling-party", "Госдума решила", "", None], lambda c: has_political_term(c, terms)) == [True, False, True, True, False, False]


@pytest.mark.parametrize("lines", [["VULGAR"], ["NONE|x"], ["ODD|x"], ["VULGAR|  "], ["VULGAR|A", "vulgar|a"], ["# only"]])
def test_faulty_dictionaries(lines):
    with pytest.raises(dictionaries.DictionaryError):
        dictionaries.parse_banned(lines)


def test_dictionary_files(spark, tmp_path):
    path = tmp_path / "terms.txt"
    path.write_text("# head\n\nVULGAR|a|b\r\nHATE|Bad Word\n")
    assert dictionaries.banned_terms(spark, str(path)) == [Term(3, "VULGAR", "a|b"), Term(4, "HATE", "bad word")]
    assert [tuple(r) for r in dictionaries.scanned(spark, str(path)).orderBy("line").collect()] == [(3, "VULGAR", "a|b"), (4, "HATE", "Bad Word")]
    with pytest.raises(dictionaries.DictionaryError):
        dictionaries.banned_terms(spark, str(tmp_path / "none.txt"))


def test_usernames(spark):
    want = {
        "IMPERSONATION": "admin moderator notrealadmin adm1n a​dmin ａｄｍｉｎ m0derat0r аdmin super-admin admin123 админ модератор moderatör platforma_admini platform_yöneticisi Official_Support rəsmi_dəstək официальная_поддержка служба_поддержки".split(),
        "SEXUAL": ["RejectBetaUser"],
        "VULGAR": ["RejectAlphaUser"],
        "NONE": "BadmintonFan AdministrativeLaw AdministeringCare ModernArtist ModularSynth SupportUkraine SupporterAli OfficialMusicFan OfficiallyBookish StaffordReader DəstəkçiAysel DestekleyiciDeniz YönetimBilimi АдминистративноеПраво ПоддерживаюАнну".split(),
    }
    names = [n for group in want.values() for n in group]
    spaced = [Term(1, "VULGAR", "reject alpha user"), Term(2, "SEXUAL", "reject beta user"), *TERMS]
    assert column(spark, names, lambda c: username_violation(c, spaced)) == [v for v, group in want.items() for _ in group]


def test_blank_and_units(spark):
    assert column(spark, ["", " \t\n", "\u00a0", "\u2003", "x", " x\n"], X.is_blank) == [True, True, False, True, False, False]
    assert column(spark, ["", "abc", "a😀"], X.utf16_length) == [0, 3, 3]
    assert column(spark, ["ab😀c", "abc"], lambda c: X.utf16_cut(c, 3)) == ["ab", "abc"]
    assert column(spark, ["ab😀c"], lambda c: X.utf16_cut(c, 4)) == ["ab😀"]
    assert column(spark, ["ab😀c", "abcd"], lambda c: X.utf16_truncate(c, 3)) == ["ab?", "abc"]
    assert column(spark, ["bad", "why?", " no. "], X.sentence) == ["bad.", "why?", "no."]


# Decision

ALLOW = {"m": "ok", "flagged": False, "c": "ok", "action": "allow", "category": "none", "investment": "related", "kind": "POST", "local": "NONE"}
GOLDEN = [
    ({"matched": True}, "BLOCK KNOWN_IMAGE"),
    ({"flagged": True, "flags": [("hate", False), ("sexual/minors", True)]}, "BLOCK SEXUAL_MINORS"),
    ({"action": "block", "category": "hate"}, "BLOCK HATE"),
    ({"action": "unknown", "category": "hate"}, "UNKNOWN HATE"),
    ({"action": "odd"}, "UNKNOWN ANALYZER_ERROR"),
    ({"category": "threat"}, "UNKNOWN THREAT"),
    ({"m": "error", "c": "error"}, "UNKNOWN ANALYZER_ERROR"),
    ({"kind": "COMMENT", "investment": None}, "ALLOW NONE"),
    ({"investment": "not_related"}, "BLOCK NOT_INVESTMENT"),
    ({"investment": "uncertain"}, "UNKNOWN NOT_INVESTMENT"),
    ({"investment": "not_related", "action": "unknown"}, "BLOCK NOT_INVESTMENT"),
    ({"investment": "not_related", "media": "error"}, "BLOCK NOT_INVESTMENT"),
    ({}, "ALLOW NONE"),
    ({"kind": "COMMENT", "local": "SEXUAL"}, "BLOCK SEXUAL"),
    ({"kind": "USERNAME", "local": "IMPERSONATION"}, "BLOCK IMPERSONATION"),
    ({"kind": "USERNAME", "local": "IMPERSONATION", "m": "error", "c": "error"}, "BLOCK IMPERSONATION"),
    ({"local": "VULGAR"}, "ALLOW NONE"),
    ({"scores": [("violence", 0.69), ("hate", 0.7)]}, "UNKNOWN HATE"),
    ({"scores": [("violence", 0.8), ("hate", 0.8)]}, "UNKNOWN VIOLENCE"),
    ({"scores": [("violence", float("nan"))]}, "ALLOW NONE"),
    ({"scores": [], "more": [("hate", 0.9)]}, "UNKNOWN HATE"),
    ({"flagged": True, "flags": [("none", True)]}, "BLOCK NONE"),
    ({"flagged": True}, "BLOCK OTHER"),
    ({"investment": "NOT_RELATED"}, "UNKNOWN NOT_INVESTMENT"),
    ({"category": None}, "ALLOW NONE"),
    ({"action": "block", "category": None}, "BLOCK OTHER"),
    ({"c": None}, "UNKNOWN ANALYZER_ERROR"),
    ({"media": "error"}, "UNKNOWN ANALYZER_ERROR"),
]


def test_decision_order(spark):
    rows = []
    for i, (changes, _) in enumerate(GOLDEN):
        x = ALLOW | {"flags": [], "scores": [], "more": None, "matched": None, "media": None} | changes
        rows.append((i, x["kind"], x["local"], x["m"], x["flagged"], x["flags"], x["scores"], x["c"], x["action"], x["category"], x["investment"], x["matched"], x["media"], x["more"]))
    entry = lambda kind: f"array<struct<key:string,value:{kind}>>"
    names = f"i int, kind string, local string, m string, flagged boolean, flags {entry('boolean')}, scores {entry('double')}, c string, action string, category string, investment string, matched boolean, media string, more {entry('double')}"
    df = spark.createDataFrame(rows, names)
    got = df.select("i", decide(*(F.col(c) for c in df.columns[1:13]), fallback_scores=F.col("more")).alias("r")).orderBy("i").collect()
    assert [f"{r['r']['decision']} {r['r']['violation']}" for r in got] == [want for _, want in GOLDEN]


# Hashes


def random_hashes(n, seed):
    random.seed(seed)
    return [f"{random.getrandbits(256):064x}" for _ in range(n)]


@pytest.mark.parametrize("threshold", [0, 7, 15, 16, 31, 32, 64, 256])
def test_nearest_equals_brute_force(spark, threshold):
    blocked = random_hashes(150, 1)
    random.seed(threshold)
    wanted = random_hashes(20, 2)
    for h in blocked[:20]:
        bits = int(h, 16)
        for b in random.sample(range(256), min(256, max(0, threshold + random.randint(-2, 2)))):
            bits ^= 1 << b
        wanted.append(f"{bits:064X}")
    q = spark.createDataFrame(list(enumerate([*wanted, "bad", None])), "id int, hash string")
    got = {r["id"]: r["distance"] for r in hamming.nearest(q, spark.createDataFrame([(h,) for h in blocked], "hash string"), threshold).collect()}
    want = {i: d for i, h in enumerate(wanted) if (d := min((int(h, 16) ^ int(b, 16)).bit_count() for b in blocked)) <= threshold}
    assert got == want


def test_nearest_at_the_pigeonhole_bound(spark):
    far = bytes(3 if i % 2 == 0 and i < 30 else 1 if i == 30 else 0 for i in range(32)).hex()
    q, b = spark.createDataFrame([(1, far)], "id int, hash string"), spark.createDataFrame([("0" * 64,)], "hash string")
    assert [tuple(r) for r in hamming.nearest(q, b, 31).collect()] == [(1, 31)]
    assert hamming.nearest(q, b, 30).count() == 0 and hamming.nearest(q, b.limit(0), 256).count() == 0
    with pytest.raises(ValueError):
        hamming.nearest(q, b, 257)


def plan_nodes(plan):
    """Nodes of a plan that has run, those of its stages too."""
    yield plan
    inner = "executedPlan" if plan.nodeName() == "AdaptiveSparkPlan" else "plan" if plan.nodeName().endswith("QueryStage") else None
    children = [getattr(plan, inner)()] if inner else [plan.children().apply(k) for k in range(plan.children().size())]
    for child in children:
        yield from plan_nodes(child)


def most_broadcast(frame) -> int:
    frame.collect()
    return max([0, *(x.metrics().apply("numOutputRows").value() for x in plan_nodes(frame._jdf.queryExecution().executedPlan()) if x.nodeName() == "BroadcastExchange")])


@pytest.mark.parametrize("threshold", [15, 31, 47])
def test_nearest_broadcasts_no_bands(spark, threshold):
    q = spark.createDataFrame(list(enumerate(random_hashes(300, 3))), "id int, hash string")
    b = spark.createDataFrame([(h,) for h in random_hashes(100, 4)], "hash string")
    assert most_broadcast(hamming.nearest(q, b, threshold)) <= 300


def test_blocked_hashes_move_no_texts(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        frame = blocked_table(spark, DATA)
        assert frame.count() == frame.distinct().count() > 0
        frame.collect()
        moved = [x.output().mkString(" ") for x in plan_nodes(frame._jdf.queryExecution().executedPlan()) if x.nodeName() == "Exchange"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert moved and not any("text" in x for x in moved)


def test_hash_words(spark):
    good, bad = ["0" * 64, "F" * 64, "0" * 63 + "3"], [None, "0" * 63, "0" * 65, "g" * 64, " " + "0" * 63]
    assert column(spark, good, lambda c: hamming.norm(hamming.words(c))) == [0, 256, 2]
    assert column(spark, bad, hamming.words) == [None] * 5
    assert column(spark, good[:1], lambda c: hamming.hexed(hamming.with_bit(hamming.words(c), 255))) == ["8" + "0" * 63]


def test_match_signal_gates(spark):
    rows = [("a", "0" * 64, 49), ("b", "0" * 64, 50), ("c", "f" * 64, 90)]
    q = spark.createDataFrame(rows, "content_id string, hash string, quality int")
    blocked = spark.createDataFrame([("0" * 63 + "1",)], "hash string")
    got = {r["content_id"]: (r["quality_accepted"], r["has_comparison"], r["matched"], r["distance"]) for r in hamming.match_signal(q, blocked).collect()}
    assert got == {"a": (False, False, False, -1), "b": (True, True, True, 1), "c": (True, True, False, -1)}
    none = {r["content_id"]: r["has_comparison"] for r in hamming.match_signal(q, blocked.limit(0)).collect()}
    assert none == {"a": False, "b": False, "c": False}


def test_match_signal_broadcasts_no_bands(spark):
    hashed = random_hashes(300, 5)
    q = spark.createDataFrame([(i, h, i % 100) for i, h in enumerate(hashed)], "content_id int, hash string, quality int")
    near = [f"{int(h, 16) ^ 7 << i % 250:064x}" for i, h in enumerate(hashed[:100])]
    signal = hamming.match_signal(q, spark.createDataFrame([(h,) for h in near], "hash string"))
    assert most_broadcast(signal) <= 300
    assert sorted((r["content_id"], r["distance"]) for r in signal.where("matched").collect()) == [(i, 3) for i in range(50, 100)]


def test_observed_sink_is_idempotent(spark, tmp_path):
    path = f"file://{tmp_path}/observed"
    df = spark.createDataFrame([("a", "1", 7, 1), ("a", "1", 3, 2), ("b", "1", 5, 3)], "content_id string, hash string, quality int, n int")
    for _ in range(2):
        hashes.append_observed(df, path, "n")
    got = spark.read.parquet(path)
    assert sorted((r["content_id"], r["quality"]) for r in got.collect()) == [("a", 7), ("b", 5)]
    assert hashes.observed_count(got).first()[0] == 2


def test_blocklist_revisions(spark, tmp_path):
    store = hashes.Blocklist(spark, f"file://{tmp_path}/blocked")
    cached = hashes.CachedBlocklist(store)
    with pytest.raises(LookupError):
        cached.current()
    assert store.write(spark.createDataFrame([], "hash string")) == 1 and cached.current().count() == 0
    assert [tuple(r) for r in store.read().collect()] == [(1, None)]
    assert store.write(spark.createDataFrame([("AB",), ("ab",)], "hash string")) == 2
    assert [r["hash"] for r in cached.current().collect()] == ["ab"]
    both = store.read(1).unionByName(store.read(2))
    with pytest.raises(LookupError):
        hashes.hashes_of(both)


# Images


def png(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def pattern(w=128, h=96):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([(17 * x + 3 * y) & 255, (5 * x + 23 * y) & 255, (11 * (x ^ y)) & 255], axis=-1).astype(np.uint8)


def test_hashes_fuzzed_printed_and_ordered(spark):
    values = ["0" * 64, "f" * 64, "8" + "0" * 63, "0" * 60 + "8000", "0123456789abcdef" * 4]
    w = hamming.words(F.col("h"))
    rows = spark.createDataFrame([(x,) for x in values], "h string").select("h", hamming.printed(w, "bits").alias("bits"), hamming.printed(w, "across").alias("across"), hamming.printed(w, "longs").alias("longs"), hamming.order_key(w).alias("key"), *(hamming.hexed(hamming.fuzzed(w, n, 5)).alias(f"f{n}") for n in (0, 1, 7))).collect()
    for r in rows:
        n = int(r["h"], 16)
        assert r["across"].replace(" ", "") == f"{n:0256b}" and r["bits"].split("\n") == [r["across"][i : i + 32] for i in range(0, 512, 32)]
        assert [int(x) % 2**64 for x in r["longs"].split()] == [int(r["h"][i : i + 16], 16) for i in range(0, 64, 16)]
        words = [int(r["h"][i : i + 4], 16) for i in range(60, -1, -4)]
        assert r["key"] == [x - (x >= 1 << 15) * (1 << 16) for x in words]
        flips = [(int(r[f"f{k}"], 16) ^ n).bit_count() for k in (0, 1, 7)]
        assert flips[:2] == [0, 1] and flips[2] <= 7 and flips[2] % 2 == 1


def test_writers_at_the_same_time_get_their_own_revisions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = hashes.Blocklist(spark, f"file://{tmp_path}/list")
    rows = [spark.createDataFrame([(f"{i:064x}",)], "hash string") for i in range(4)]
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(store.write, rows))
    assert sorted(numbers) == [1, 2, 3, 4] and store.revision() == 4
    assert {r["hash"] for r in store.read().collect()} == {f"{numbers.index(4):064x}"}


def test_pdq_pin():
    assert pdq.pdq(pattern()) == ("ae4b8be12d8a8124d50f7ba5d62f6bbcfdcf6c81de6d2082a88a5dc10401ffe4", 100)
    assert pdq.pdq(np.zeros((20, 20, 3), np.uint8))[1] == 0


def test_pdq_of_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(pattern()))
    (tmp_path / "c.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 5, 6) + b"\0\0\0" + 2 * (b"\x2c" + bytes(9) + b"\2\1x\0") + b";")
    (tmp_path / "d.png").write_bytes(png(pattern())[:16] + struct.pack(">II", 100_000, 100_000) + bytes(20))
    faults = {r["path"].rsplit("/", 1)[1]: r["fault"] for r in images.read_files(spark, str(tmp_path)).collect()}
    assert faults == {"a.png": None, "c.gif": "animated images are not supported", "d.png": "image exceeds pixel limit"}
    (tmp_path / "b.png").write_bytes(png(pattern()))  # the same picture under another name
    got = pdq.hashed(images.read_pixels(spark, str(tmp_path)).withColumnRenamed("path", "content_id")).collect()
    assert len({r["content_id"] for r in got}) == 2
    (tmp_path / "b.png").unlink()
    got = pdq.hashed(images.read_pixels(spark, str(tmp_path)).withColumnRenamed("path", "content_id")).collect()
    assert [(r["hash"], r["quality"]) for r in got] == [pdq.pdq(pattern())]


def test_headers():
    assert images.header(png(pattern()))[:3] == ("png", 128, 96)
    jpeg = b"\xff\xd8\xff\xe0\0\4xx\xff\xc0\0\x0b\x08\0\x30\0\x40\x01\0\0\0"
    assert images.header(jpeg) == ("jpeg", 64, 48, 1)
    assert images.header(b"plain")[0] is None


def test_dihedral_hashes_match_turned_images():
    y, x = np.mgrid[0:512, 0:512] / 512.0
    a = np.stack([128 + 50 * np.sin(7 * x + 3 * y) + 40 * np.cos(5 * x * y + 9 * y + k) for k in range(3)], axis=-1).astype(np.uint8)
    near = lambda x, y: (int(x, 16) ^ int(y, 16)).bit_count()
    got = pdq.dihedral(a)
    assert got["original"] == pdq.pdq(a)[0]
    assert near(got["transpose"], pdq.pdq(np.ascontiguousarray(a.transpose(1, 0, 2)))[0]) <= 30
    assert near(got["flip_columns"], pdq.pdq(np.ascontiguousarray(a[:, ::-1]))[0]) <= 40


# OCR


def test_ocr_states(spark):
    got = column(spark, ["Salam  Bakı\n\tﬁkir", " \t ", None, "a\x01b"], lambda c: ocr.result(c))
    assert [tuple(r) for r in got] == [("ok", "Salam Bakı fikir"), ("no_text", None), ("no_text", None), ("ok", "ab")]
    assert tuple(column(spark, ["x"], lambda c: ocr.result(c, enabled=False))[0]) == ("disabled", None)
    assert tuple(column(spark, ["x"], lambda c: ocr.result(c, failed=F.lit(True)))[0]) == ("error", None)
    assert column(spark, ["ab😀c"], lambda c: ocr.normalized(c, 3)) == ["ab"]
    assert ocr.languages("AZE + eng+aze") == ("aze", "eng")
    with pytest.raises(ValueError):
        ocr.languages("eng+")


def test_ocr_merge(spark):
    long = "x" * 19_982
    df = spark.createDataFrame([(0, "", "ok", "seen"), (1, "post", "ok", "seen"), (2, "post", "error", None), (3, long, "ok", "abc😀tail"), (4, "y" * 20_000, "ok", "seen")], "i int, t string, s string, o string")
    got = [r["x"] for r in df.select("i", ocr.analysis_text(F.col("t"), F.col("s"), F.col("o")).alias("x")).orderBy("i").collect()]
    assert got[:3] == ["Image text:\nseen", "post\n\nImage text:\nseen", "post"]
    assert got[3].endswith("Image text:\nabc") and got[4] == "y" * 20_000


# Providers


def test_entries_keep_types_and_order(spark):
    raw = '{"b":true,"a":"true","c":false}'
    assert [tuple(e) for e in column(spark, [raw], P.true_entries)[0]] == [("b", True), ("a", False), ("c", False)]
    raw = '{"z":0.5,"a":"0.9","m":1e-1,"n":null}'
    assert [tuple(e) for e in column(spark, [raw], P.number_entries)[0]] == [("z", 0.5), ("a", None), ("m", 0.1), ("n", None)]


def test_requests_are_json(spark):
    text = 'say "hi"\n'
    got = json.loads(column(spark, [text], lambda c: P.classification_text_request("m", F.lit("COMMENT"), c))[0])
    assert got["store"] is False and got["max_output_tokens"] == 120 and got["input"][1]["content"].endswith(f"<content>{text}</content>")
    assert got["text"]["format"]["schema"]["properties"]["category"]["enum"][-1] == "vulgar" and "investment" not in got["text"]["format"]["schema"]["properties"]
    image = json.loads(column(spark, [" "], lambda c: P.classification_image_request("m", F.lit("POST"), F.encode(F.lit("x" * 90), "UTF-8"), F.lit("image/png"), c))[0])
    assert "[none]" in image["input"][1]["content"][0]["text"] and "\n" not in image["input"][1]["content"][1]["image_url"]
    assert len(json.loads(column(spark, [""], lambda c: P.moderation_image_request("m", F.encode(F.lit("x"), "UTF-8"), F.lit("image/png"), c))[0])["input"]) == 1


# Accuracy, settings, pipeline, stream


def test_case_rules(spark, tmp_path):
    good = {"id": "1", "contentType": "POST", "language": "EN", "text": "x", "expected": {"decision": "ALLOW", "violation": "NONE", "investment": "RELATED", "politics": "NOT_RELATED"}}
    bad = [good | {"id": "2", "language": "DE"}, good | {"id": "3", "contentType": "COMMENT"}, good | {"id": "", "text": "y"}]
    path = tmp_path / "cases.jsonl"
    path.write_text("\n".join(map(json.dumps, [good, *bad])))
    df = cases.read_cases(spark, str(path))
    assert sorted((r["id"], r["v"]) for r in df.select("id", accuracy.valid_case().alias("v")).collect()) == [("", False), ("1", True), ("2", False), ("3", False)]
    answers = spark.createDataFrame([("1", True, "1", "POST", "ALLOW", "NONE", "RELATED", None)], "id string, ok boolean, contentId string, contentType string, decision string, violation string, investment string, politics string")
    rows = accuracy.compared(df.where("id = '1'"), answers)
    assert rows.first()["politics_right"] is False and rows.first()["case_pass"] is False
    assert accuracy.exit_code(rows) == 0 and accuracy.exit_code(rows, 50) == 3
    assert accuracy.exit_code(accuracy.compared(df, answers)) == 2
    assert {r["metric"]: r["percent"] for r in accuracy.summary(rows).collect()}["label_field"] == "75.00"


@pytest.mark.parametrize("change", [{"distance_threshold": 257}, {"quality_threshold": -1}, {"max_image_bytes": 0}, {"ocr_timeout_seconds": 61}, {"ocr_concurrency": 9}, {"ocr_languages": ("deu",)}])
def test_settings_are_checked(change):
    MediaSettings()
    with pytest.raises(ValueError):
        MediaSettings(**change)


def requests(spark):
    rows = [
        ("1", "post", "hello", None, None), ("2", "comment", "reject alpha", None, None), ("3", "USERNAME", "admin", None, None), ("4", "POST", "", b"img", "image/png"),
        ("5", "COMMENT", "x", b"img", "image/png"), ("6", "odd", "x", None, None), ("7", "POST", "", b"img", "text/plain"), ("8", "POST", " ", None, None), ("9", "POST", "", b"img", "image/PNG"),
    ]
    return spark.createDataFrame(rows, "content_id string, content_type string, text string, image binary, image_content_type string")


def provider_answers(spark):
    moderation_raw = '{"results":[{"flagged":false,"categories":{},"category_scores":{"hate":0.1}}]}'
    answer = json.dumps({"output": [{"type": "message", "content": [{"type": "output_text", "text": json.dumps({"action": "allow", "category": "none", "investment": "related", "politics": "not_related"})}]}]})
    return spark.createDataFrame([(str(i), moderation_raw, answer) for i in range(1, 10)], moderation.ANSWERS)


def test_pipeline(spark):
    media = spark.createDataFrame([("4", "ok", True, True, "ok", "the government", 200), ("9", "error", None, None, None, None, 400)], moderation.MEDIA)
    responses, rejects = moderation.moderate(requests(spark), media, provider_answers(spark), TERMS, dictionaries.political_terms())
    got = {r["content_id"]: tuple(r)[2:] for r in responses.collect()}
    assert got == {
        "1": ("ALLOW", "NONE", "RELATED", "NOT_RELATED", None),
        "2": ("BLOCK", "VULGAR", None, "NOT_RELATED", None),
        "3": ("BLOCK", "IMPERSONATION", None, None, None),
        "4": ("BLOCK", "KNOWN_IMAGE", "RELATED", "UNCERTAIN", "MATCHED"),
    }
    assert {r["content_id"]: r["http_status"] for r in rejects.collect()} == {"5": 400, "6": 400, "7": 415, "8": 400, "9": 422}
    assert json.loads(next(r["body"] for r in moderation.as_json(responses).collect() if r["content_id"] == "3")) == {"contentId": "3", "contentType": "USERNAME", "decision": "BLOCK", "violation": "IMPERSONATION"}


def test_missing_signals_degrade(spark):
    none = provider_answers(spark).limit(0)
    responses, _ = moderation.moderate(requests(spark), spark.createDataFrame([], moderation.MEDIA), none, TERMS, ["law"])
    got = {r["content_id"]: (r["decision"], r["violation"], r["image_match"]) for r in responses.collect()}
    assert got["1"] == ("UNKNOWN", "ANALYZER_ERROR", None) and got["4"] == ("UNKNOWN", "ANALYZER_ERROR", "UNAVAILABLE") and got["2"] == ("BLOCK", "VULGAR", None)


def test_request_ids(spark):
    assert column(spark, ["given"], lambda c: V.request_id(c)) == ["given"]
    assert len(column(spark, [" "], lambda c: V.request_id(c))[0]) == 36


def test_stream_equals_batch(spark, tmp_path):
    source = f"{tmp_path}/in"
    requests(spark).repartition(3).write.parquet(source)
    decide_all = lambda df: moderation.moderate(df, spark.createDataFrame([], moderation.MEDIA), provider_answers(spark), TERMS, ["law"])[0]
    stream = spark.readStream.schema(requests(spark).schema).option("maxFilesPerTrigger", 1).parquet(source)
    run_batches(stream, decide_all, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, decide_all(requests(spark)).collect()))
    observed = spark.createDataFrame([("a", "1", 5), ("a", "1", 5)], hashes.OBSERVED)
    observed.write.parquet(f"{tmp_path}/seen")
    store_hashes(spark.readStream.schema(observed.schema).parquet(f"{tmp_path}/seen"), f"{tmp_path}/kept", f"{tmp_path}/checkpoint2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 1
