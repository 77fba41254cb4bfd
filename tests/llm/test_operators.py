"""Training-data operators on hand-made tables: nulls, empty and long texts, repeated rows,
empty tables, clashing columns, and brute-force versions of each result."""

import hashlib
import random
import re
import time
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from tessera.llm import (
    decontaminate, exact_dedup, html_text, langid, mixing, pii, repeats, secrets, simhash, substring_dedup, suffix_dedup,
)
from tessera.llm.common import arrow_rows

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size string, taken int, kept string, "
          "fp string, rid int, blob string, score string, row string, spans int")
WORDS = [f"{a}{b}" for a in "ba ke li mo nu ra se ti".split() for b in ("", "n", "s", "na", "ló")]


def _texts():
    rnd = random.Random(5)
    passage = " ".join(rnd.choice(WORDS) for _ in range(120))
    def words(n):
        return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 999)) for _ in range(n))
    out = [None, "", " \n\t ", "one", "x" * 3000, "ab " * 900, words(40), words(9000)]
    out += [words(50) + " " + passage + "\n" + words(60) for _ in range(4)]
    out += [passage, passage, words(30), "Ünï " + words(40) + "  " + "é" * 500]
    same = words(200)
    out += [same, same, same + " tail", same.replace(" ", "\n", 3)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    texts = _texts()
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 4 else f"s{i % 3}", 0, "q", 1, "k", "f", 2, "b", "s", "r", 3)
            for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "no id", *rows[0][2:]), (None, None, *rows[0][2:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def test_exact_duplicates(docs, empty):
    got = exact_dedup.exact_duplicates(docs).collect()
    rows = _rows(docs)
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text, []).append(doc_id)
    want = Counter()
    for text, ids in groups.items():
        best = max((d for d in ids if d is not None), default=None)
        last = ids.index(best)
        want.update((d, best, len(ids), i == last, hashlib.sha256(text.encode()).hexdigest()) for i, d in enumerate(ids))
    assert Counter(map(tuple, got)) == want
    assert len(got) == len(rows) > len(set(rows))


def test_hot_texts_reach_no_exchange(spark):
    """Of a table with one text in half its rows, the rows with other texts alone are shuffled."""
    frame = spark.createDataFrame([(i, "hot" if i % 2 else f"t{i % 600}") for i in range(4000)], "doc_id long, text string")
    found = exact_dedup.exact_duplicates(frame.repartition(4))
    assert found.where("group_size = 2000").count() == 2000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "Distinct" not in plan and "Deduplicate" not in plan
    found.write.format("noop").mode("overwrite").save()
    nodes = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in nodes


def test_heavy_digest_is_mapped_not_shuffled(spark):
    rows = spark.range(6000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot', concat('t', id)) AS text")
    got = exact_dedup.exact_duplicates(rows)
    hot = got.where("group_size > 1").selectExpr("count(*) n", "min(keep_id) k", "max(group_size) g").first()
    assert (hot["n"], hot["k"], hot["g"]) == (2000, 5997, 2000)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()


def _size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def test_mix(docs, empty):
    got = mixing.mix_to_weights(docs).collect()
    assert len(got) == docs.count()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((d or -1, _size(t)) for d, t in _rows(docs))
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    targets = {(r["source_size"], r["target"]) for r in got}
    assert all(t <= 2 * s for s, t in targets) and abs(sum(t for _, t in targets) - 1.5 * total) < 1e-6
    for s, t in targets:
        own = [r for r in got if (r["source_size"], r["target"]) == (s, t)]
        assert abs(sum(r["taken"] for r in own) - t) <= max(r["size"] for r in own)
    again = mixing.mix_to_weights(docs.repartition(5)).collect()
    key = lambda r: (r["doc_id"] or -1, r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix_to_weights(empty).count() == 0


def test_running_sums_over_ranges(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, f"s{rnd.randint(0, 40)}"]), rnd.randint(0, 9)) for _ in range(300)]
    rows = [(s, n, i) for i, (s, n) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "s string, n long, i long")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # no merging: several ranges
    try:
        got = mixing._running(frame, [F.col("s").asc_nulls_last(), F.col("i")], {"upto": F.col("n")}).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    want, total = {}, 0
    for s, n, i in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[2])):
        total += n
        want[i] = total
    assert {r["i"]: r["upto"] for r in got} == want


@pytest.mark.parametrize("weights, budget", [((3, 1, 2), 1.5), ((1, 9), 0.5), ((5, 1, 1), 2.0)])
def test_targets_share_by_weight(spark, weights, budget):
    sizes = {"a": 100, "b": 1000, "c": 10, None: 300}
    sized = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sized, weights, budget, 2).collect()}
    w = {k: weights[i % len(weights)] for i, k in enumerate(["a", "b", "c", None])}
    goal, open_, left = {}, set(sizes), budget * sum(sizes.values())
    while open_:
        share = {k: left * w[k] / sum(w[x] for x in open_) for k in open_}
        full = {k for k in open_ if share[k] >= 2 * sizes[k]}
        goal |= {k: 2.0 * sizes[k] if k in full else share[k] for k in (full or open_)}
        left -= sum(goal[k] for k in full)
        open_ = open_ - full if full else set()
    assert got == pytest.approx(goal)


def _fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    fps = {}
    for d, t in _rows(docs):
        fps.setdefault(_fingerprint(t), []).append(d)
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter(
        (d, f"{_fingerprint(t):016x}") for d, t in _rows(docs))
    left = {f: {f} for f in fps}
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 2 and left[a] is not left[b]:
                left[a] |= left[b]
                for x in left[b]:
                    left[x] = left[a]
    for r in got:
        ids = [d for f in left[int(r["fingerprint"], 16)] for d in fps[f] if d is not None]
        assert r["component_id"] == min(ids, default=None)
    assert simhash.near_duplicates(empty).count() == 0


def test_covering_masks_cover():
    rnd = random.Random(2)
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for _ in range(2000):
        change = sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 2)))
        assert any(not change & m for m in masks)


def test_links_in_a_crowded_bucket(spark):
    rnd = random.Random(3)
    base = rnd.getrandbits(63)
    near = {base} | {base ^ (1 << rnd.randrange(63)) ^ (1 << rnd.randrange(63)) for _ in range(300)}
    near |= {rnd.getrandbits(63) for _ in range(50)}
    edges = simhash.links(spark.createDataFrame([(x,) for x in near], "fp long"))
    labels = {r["node"]: r["label"] for r in simhash.components(edges).collect()}
    want = {x: {x} for x in near}
    for a in near:
        for b in near:
            if (a ^ b).bit_count() <= 2 and want[a] is not want[b]:
                want[a] |= want[b]
                for x in want[b]:
                    want[x] = want[a]
    assert all(labels.get(x, x) == min(want[x]) for x in near)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r["node"]: r["label"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def _removed(units, width):
    """Covered units of every text, by counting all windows."""
    seen = Counter(tuple(u[i:i + width]) for u in units for i in range(len(u) - width + 1))
    out = []
    for u in units:
        gone = set()
        for i in range(len(u) - width + 1):
            if seen[tuple(u[i:i + width])] > 1:
                gone.update(range(i, i + width))
        out.append(gone)
    return out


@pytest.mark.parametrize("hot", [None, 1])
def test_repeated_bytes_and_words(docs, empty, monkeypatch, hot):
    if hot is not None:  # every shared minimiser takes the way of the crowded ones
        monkeypatch.setattr(repeats, "HOT_STRINGS", hot)
    rows = _rows(docs)
    got = suffix_dedup.remove_repeated_bytes(docs, width=60, gram=20).collect()
    want = Counter()
    for (d, t), gone in zip(rows, _removed([t.encode() for _, t in rows], 60)):
        kept = bytes(c for i, c in enumerate(t.encode()) if i not in gone)
        spans = sum(i - 1 not in gone for i in gone)
        want[d, len(t.encode()), len(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    got = substring_dedup.remove_repeated_words(docs, width=8, gram=3).collect()
    want = Counter()
    for (d, t), gone in zip(rows, _removed([t.encode().split() for _, t in rows], 8)):
        words = t.encode().split()
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        want[d, len(words), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_units"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    if hot is None:
        assert suffix_dedup.remove_repeated_bytes(empty).count() == substring_dedup.remove_repeated_words(empty).count() == 0


def test_transform_finds_every_repeat():
    rnd = random.Random(1)
    for trial in range(60):
        width = rnd.choice([1, 2, 3, 5, 8])
        strings = [bytes(rnd.choice(b"ab" if trial % 2 else b"abcd") for _ in range(rnd.randint(width, 50)))
                   for _ in range(rnd.randint(1, 6))]
        seen = Counter(s[i:i + width] for s in strings for i in range(len(s) - width + 1))
        want = {(k, i) for k, s in enumerate(strings) for i in range(len(s) - width + 1) if seen[s[i:i + width]] > 1}
        for compare, unit in ((suffix_dedup.compare_strings, "byte"),):
            assert {(k, i) for k, a, b in compare(strings, repeats.Units(unit, width, 1)) for i in range(a, b)} == want


def test_long_texts_are_hashed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STEP_UNITS", 256)
    rnd = random.Random(4)
    block = "".join(rnd.choice("abcdef ") for _ in range(90))
    texts = ["".join(rnd.choice("abcdef ") for _ in range(1500)) + block + "".join(rnd.choice("ab") for _ in range(700)),
             block, "".join(rnd.choice("abcdef ") for _ in range(513))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeated_bytes(frame, width=40, gram=10).collect()}
    assert got == {i: len(g) for i, g in enumerate(_removed([t.encode() for t in texts], 40))}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


@pytest.mark.parametrize("block", [20_000, 3])
def test_contamination(spark, docs, empty, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_PHRASES", block)
    texts = dict(_rows(docs))
    items = [(1, texts[12][:200]), (10, "ONE"), (2, None), (3, "..."), (4, texts[9][40:300].upper()), (4, "x y"),
             (None, " ".join(texts[7].split()[20:33]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    phrases = {}
    for i, t in items:
        w = _words(t or "")
        for a in range(max(len(w) - 9, min(len(w), 1))):
            phrases.setdefault(tuple(w[a:a + 10]), set()).add("" if i is None else str(i))
    want = Counter()
    for d, t in _rows(docs):
        w, hit, found = _words(t), set(), set()
        for p, owners in phrases.items():
            for a in range(len(w) - len(p) + 1):
                if tuple(w[a:a + len(p)]) == p:
                    hit.update(range(a, a + len(p)))
                    found |= owners
        want[d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    got = decontaminate.contamination(docs, bench).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])
                   for r in got) == want
    assert sum(r["contaminated"] for r in got) > 3
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0


def test_index_comes_in_small_row_groups_and_batches(spark, docs, monkeypatch):
    """Shards are rows of megabytes: no task holds more than a few, however large its split."""
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 1)
    index = decontaminate.build_index(docs.coalesce(1))
    groups = [m.row_group(g).num_rows for f in index.inputFiles()
              for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for g in range(m.num_row_groups)]
    assert sum(groups) == docs.count() and max(groups) <= decontaminate.GROUP_SHARDS

    seen = []
    found = DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        seen.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return found(self, path, *args, **kwargs)
    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    phrases = spark.createDataFrame([(1, 0, "a b")], "number long, block int, phrase string")
    decontaminate.find_phrases(index, phrases)
    assert seen and max(seen) <= decontaminate.GROUP_SHARDS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    with arrow_rows(spark, 3):
        sizes = spark.range(10).coalesce(1).mapInArrow(
            lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert sorted(r["n"] for r in sizes) == [1, 3, 3, 3]


def test_proximity(spark):
    frame = spark.createDataFrame([(1, "a b c d"), (2, "a x b c d"), (3, "a x x x b c d"), (4, "d c b a")],
                                  "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    def hit(slop):
        return {r["doc_id"] for r in decontaminate.contamination(frame, bench, slop=slop).where("contaminated").collect()}
    assert hit(0) == {1} and hit(1) == {1, 2} and 3 in hit(3)


def test_language_profiles(spark, docs, empty):
    got = langid.language_of(docs)
    assert got.count() == docs.count()
    und = {r["doc_id"] for r in got.where("lang_pred = 'und'").collect()}
    assert {0, 1, 2} <= und and got.where("score < 0 OR score > 1").count() == 0
    assert langid.language_of(empty).count() == 0
    none = docs.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert langid.language_of(none).where("lang_pred != 'und' OR score != 0").count() == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.where("doc_id IN (0, 1, 2)").count() == 0


def test_bundles_in_pieces_are_equal(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abc d中国人民 é") for _ in range(n)) for n in (0, 1, 7, 400, 3000)] + [None, "x" * 900]
    letters = langid._letter_table()
    whole = langid._grouped(texts, letters, 64, 1, range(len(texts)), len(texts))
    monkeypatch.setattr(langid, "PIECE", 100)
    monkeypatch.setattr(langid, "GRAM_BLOCK", 9)
    assert (langid._grouped(texts, letters, 64, 1, range(len(texts)), len(texts)) == whole).all()
    assert whole[4].any() and not whole[5].any()


def test_language_accuracy(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    got = langid.language_of(frame).join(frame.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    right, n = got.selectExpr("count_if(lang = lang_pred) a", "count(*) n").first()
    assert n > 100 and right / n > 0.95


SECRETS = ['password = "hunter22"', "api_key: abc", "TOKEN=secret=abcdef99", "AKIA" + "A" * 16 + " AKIAAKIA" + "Z9" * 8,
           "AKIA" + "Q" * 15, "f" * 24 + "g" + "0" * 23, "é password='ütoken:   Aa1+/_.=-", "ſecret=abcdefg", None, "",
           "passwd=" + "0123456789abcdef" * 4]


def _spans(text):
    out = []
    for order, (kind, pattern, group, least) in enumerate(secrets.RULES):
        flags = re.ASCII | re.IGNORECASE if kind == "assign" else re.ASCII
        out += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text, flags)
                if len(m.group(group)) >= least]
    return ",".join(x for *_, x in sorted(out))


def test_secret_ledger(spark, empty):
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(SECRETS + SECRETS[:2])] + [(3, SECRETS[3], 1)],
                                  "doc_id long, text string, blob int")
    ledger = secrets.BlobLedger(spark)
    got = secrets.secret_digests(secrets.scan_secrets(frame, ledger)).collect()
    want = Counter((i, _spans(t or "")) for i, t in [*enumerate(SECRETS + SECRETS[:2]), (3, SECRETS[3])])
    assert Counter((r["doc_id"], r["spans"]) for r in got) == want
    assert all(hashlib.sha256(r["spans"].encode()).hexdigest() == r["base_sha256"] for r in got)
    before = ledger.rows().count()
    assert ledger.rows().select("blob").distinct().count() == len({t or "" for t in SECRETS})
    secrets.scan_secrets(frame, ledger).count()
    assert ledger.rows().count() == before  # nothing new to scan
    more = frame.unionByName(spark.createDataFrame([(99, "secret=newsecret", 1)], frame.schema))
    assert secrets.secret_digests(secrets.scan_secrets(more, ledger)).where("doc_id = 99").first()["n_assign"] == 1
    assert ledger.rows().count() == before + 1
    assert secrets.scan_secrets(empty).count() == 0


PERSONAL = ["Write Anna.B@mail2.example.com or anna.b@mail2.example.com", "+1 (988) 555-2485 4565410125667261 82.43.185.109",
            "Mrs Anna Smith met Robert SMITH. Mr Smith left", "DE89 3704 0044 0532 0130 00 and 123-45-6789",
            "Господин Иванов, 82.43.185.109", "Of Of Of and the Mr. of 1234", None, "", "10 20 30"]


def test_surrogates(spark, empty):
    frame = spark.createDataFrame([(i, t, 0) for i, t in enumerate(PERSONAL)] + [(0, PERSONAL[0], 0)],
                                  "doc_id long, text string, blob int")
    got = {r["doc_id"]: r for r in pii.replace_personal_data(frame, b"k").collect()}
    for i in (5, 6, 7, 8):
        assert got[i]["text"] == PERSONAL[i] and got[i]["n_found"] == 0
    assert [got[i]["kinds"] for i in range(5)] == [
        "email,email", "phone,card,ip", "given,surname,given,surname,surname", "iban,ssn", "surname,ip"]
    for i in range(5):
        assert not any(PERSONAL[i][e.start:e.end] in got[i]["text"] for e in pii.detect(PERSONAL[i]))
    a, b = got[0]["text"].split()[1], got[0]["text"].split()[3]
    assert a.lower() == b.lower() and a != b and a.endswith(".example.com")
    assert got[1]["text"].startswith("+1 (") and len(got[1]["text"].split()[3]) == 16
    smith = re.fullmatch(r"Mrs \w+ (\w+) met \w+ (\w+)\. Mr (\w+) left", got[2]["text"])
    assert smith[1] == smith[3] == smith[2].capitalize() and smith[2].isupper()
    assert got[1]["text"].split()[-1] == got[4]["text"].split()[-1]
    assert re.search("[а-я]", got[4]["text"].split()[1])
    assert pii.replace_personal_data(empty, b"k").count() == 0
    other = {r["doc_id"]: r["text"] for r in pii.replace_personal_data(frame, b"other").collect()}
    assert other[1] != got[1]["text"]


def test_entities_with_odd_letters_and_digits():
    for text in ("DAVİD Smith", "Mıss Smith", "Mrſ Smith", "٠١٢-٣٤-٥٦٧٨", "+٤٩ 30 1234567", "١.2.3.4 x", "4٠00 0000 0000 0000"):
        for e in pii.detect(text):
            new = pii.surrogate(b"k", e.kind, e.canonical, e.shape)
            assert pii.dress(text[e.start:e.end], e.kind, new)
    assert [e.shape for e in pii.detect("Mıss SİBEL Smith")] == ["f:LATIN", "LATIN"]


@pytest.mark.parametrize("text, names", [
    ("Mr Smith and Mrs Jones left", "Smith Jones"), ("Mr. Smith met Mrs. Jones", "Smith Jones"),
    ("Mr. and Mrs. Smith", "Smith"), ("We miss Dr Jones", "Jones"), ("John and Mary Smith", "Mary Smith"),
    ("Robert met Mary Jones", "Mary Jones"), ("Herr Dr. Schmidt kam", "Schmidt"), ("Mr Don Jones", "Don Jones"),
    ("John Smith Mrs Jones", "John Smith Jones"), ("John Thomas Mary Smith", "John Thomas Mary Smith")])
def test_names_close_together(text, names):
    assert " ".join(text[e.start:e.end] for e in pii.detect(text)) == names


ALONE = ["+33 6 12 34 56 78", "+33612345678", "(212) 555-0199", "Господин Иванов", "Мария Петрова", "FRANÇOIS Petit",
         "SEÑORA Lopez", "Mr Smith", "John Smith", "a.b@example.com", "DE89 3704 0044 0532 0130 00",
         "4565410125667261", "1.2.3.4", "123-45-6789"]


def test_every_kind_alone_in_a_text(spark):
    frame = spark.createDataFrame([(i, f"« {t} »") for i, t in enumerate(ALONE)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.replace_personal_data(frame, b"k").collect()}
    for i, t in enumerate(ALONE):
        assert got[i]["n_found"] > 0 and got[i]["text"] != f"« {t} »", t


def test_hints_hold_in_every_match():
    rng = random.Random(9)
    for _ in range(20000):
        text = "".join(rng.choice("+1234567890 .-()A@a") for _ in range(rng.randint(8, 24)))
        for kind, pattern in pii.PATTERNS:
            assert not pattern.search(text) or pii.HOLDS[kind].search(text)


def test_surrogates_stay_distinct(spark):
    rows = [("ip", f"{a}.{b}.{c}.1", "") for a in range(1, 10) for b in range(1, 10) for c in range(1, 10)]
    got = pii.assign_surrogates(spark.createDataFrame(rows, "kind string, canonical string, shape string"), b"k").collect()
    new = [r["new"] for r in got]
    assert len(set(new)) == len(rows) and not set(new) & {r[1] for r in rows}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Top</header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- x --><div class="ad">Buy now</div>
<div class="cookie-notice">We use cookies</div><article><h1>Head&amp;line</h1><p><b>First  para&nbsp;graph<br>goes on.<p>Short.
<div class="newsletter"><form><p>Subscribe</p></form></div><p>Tom &lt;3 &#x4a;erry</p><aside>Side</aside></article>
<section id="comments"><article class="comment"><p>Nice!</p></article></section><footer>&copy; me</footer></body>"""


def test_main_text(spark):
    long = "The cat is on the mat and it was not in the house with her dog. " * 5
    plain = f"<body><p><a href=x>Menu</a> <a href=y>More</a></p><h2>Title</h2><p>{long}</p><p>Yes.</p><p>{long}</p><p>\xa9 all rights</p>"
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>a < b & c"), (5, "u", plain), (None, "u", "<div")]
    frame = spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_text.extract_main_text(frame).collect()}
    assert got[1]["text"] == "Head&line\nFirst para graph goes on.\nShort.\nTom <3 Jerry"
    assert got[2]["text"] == got[3]["text"] == "" and got[2]["n_chars"] == 0
    assert got[4]["text"] == "a < b & c"
    clean = " ".join(long.split())
    assert got[5]["text"] == f"Title\n{clean}\nYes.\n{clean}"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_text.extract_main_text(frame.limit(0)).count() == 0


PROSE = ("The cat is on the mat and it was not in the house with her dog. " * 5).strip()


@pytest.mark.parametrize("page", [
    "<html><head><title>x</title><body><p>{}", "<head><title>x</title><p>{}", "<datalist><option value=a></datalist><p>{}",
    "<audio src=x><p>{}", "<div><a class=share href=x>s <a href=y>t</a><p>{}</p></div>",
    "<div class='content social'><article><p>{}</p></article></div>", "<div class=banner><main><p>{}</p></main></div>",
    "<article><p>{}</p></article><div class=related><article><p>Teaser</p></article></div>"])
def test_optional_end_tags_and_wrappers(page):
    assert html_text.main_text(page.format(PROSE)) == PROSE


def test_unclosed_button_keeps_what_follows():
    assert PROSE in html_text.main_text(f"<button>x<p>{PROSE}</p><button>B</button>").split("\n")


@pytest.mark.parametrize("junk", [
    "<ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul>", "<div>Deal: <a href=x>cheap shoes</a></div>",
    "<p>" + "<a href=x>Something else worth reading elsewhere</a> " * 4 + "</p>",
    "<ul><li><a href=x>One</a></li><li>Short</li><li><a href=y>Two</a></li></ul>"])
def test_links_and_adverts_inside_an_article(junk):
    page = f"<article><h1><a href=t>Title</a></h1><p>{PROSE}</p>{junk}<p>{PROSE}</p></article>"
    assert html_text.main_text(page) == f"Title\n{PROSE}\n{PROSE}"


NEWS = ["The company reported quarterly revenue of $4.2bn on Tuesday, beating analyst estimates amid strong cloud demand.",
        "Apple, Google, Microsoft, Amazon shares fell sharply Monday amid renewed tariff fears, Wall Street analysts said.",
        "Die Regierung kündigte am Dienstag neue Investitionen in Schulen, Straßen und Brücken an, berichteten Zeitungen.",
        "Il governo ha annunciato martedì nuovi investimenti per scuole, strade e ponti in tutte le regioni italiane.",
        "Rząd ogłosił we wtorek nowe inwestycje w szkoły, drogi oraz mosty, poinformowały największe krajowe dzienniki.",
        "Правительство объявило во вторник новые инвестиции в школы, дороги и мосты, сообщили крупнейшие газеты страны.",
        "政府は火曜日に新しい投資計画を発表し、学校や道路や橋の整備を進めると述べた。" * 3]


@pytest.mark.parametrize("text", NEWS)
def test_news_without_a_marked_article(text):
    menu = "<ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul>"
    assert html_text.main_text(f"<body>{menu}<p>{text}</p><p>{text}</p>{menu}</body>").split("\n") == [text, text]


def test_copyright_sign_in_a_long_paragraph():
    assert html_text.main_text(f"<p>{PROSE} \xa9 someone</p><p>\xa9 all rights</p>") == f"{PROSE} \xa9 someone"


PARAGRAPHS = "".join(f"<p>{PROSE}</p>" for _ in range(4))
ALL_OF_IT = "\n".join([PROSE] * 4)


@pytest.mark.parametrize("page", [
    "<div class='site has-sidebar'>{}</div>", "<div id=content-sidebar-wrap>{}</div>", "<div class='page nav-fixed'>{}</div>",
    "<section class=social-studies>{}</section>", "<form id=aspnetForm>{}</form>", "<form id=aspnetForm><article>{}</article></form>",
    "<div class=post>{}</div><article><a href=x>Read on</a> and a few words of a teaser</article>", "<div class=comments-open>{}</div>",
    "<div class=post>{}</div><div class=comments>" + PARAGRAPHS * 3 + "</div>",
    "<div class=has-sidebar><div class=post>{}</div><div class=sidebar><p>" + PROSE[:130] + "</p></div></div>",
    "<div class=has-sidebar><div class='page nav-top'><form>{}</form></div></div>",
    "<div class=post>{}</div><form><p>" + PROSE + "</p></form>"])
def test_names_of_wrappers_lose_no_page(page):
    assert html_text.main_text(page.format(PARAGRAPHS)) == ALL_OF_IT


def test_every_paragraph_in_a_widget_of_its_own():
    page = "".join(f"<div class='elementor-widget x'><p>{PROSE}</p></div>" for _ in range(4))
    assert html_text.main_text(page + f"<div class=sidebar><p>{PROSE[:130]}</p></div><div class=newsletter><p>{PROSE}</p></div>") == ALL_OF_IT
    assert html_text.main_text("<div class=cookie-notice><p>We use cookies to make this site better for you and for all.</p></div>") == ""


@pytest.mark.parametrize("junk", [
    "<a ", "<div>", "<table><tr><td>", "<p>", "<a href=\"", "<div class=ad>x", "<svg>", "<li>", "<option>", "</svg ", "<i><b>",
    "<a class=ad><div class=ad>", "<a 'x\"", "<ul><li><div>", "</i>", "<div class=widget><p>word word "])
def test_long_pages_take_time_in_proportion(junk):
    """Four times the page takes about four times as long, whatever it repeats."""
    def seconds(n):
        start = time.process_time()
        html_text.main_text(junk * (n // len(junk)))
        return time.process_time() - start
    seconds(20_000)
    assert seconds(240_000) < 10 * max(seconds(60_000), 0.02)


def _block_rules(paragraphs, rules=html_text.Rules()):
    """The two passes over a page of bare paragraphs (text, linked characters), spelled out."""
    lists = [frozenset(v.split()) for v in html_text.STOP_WORDS.values()]
    def stops(text, which):
        words = [w.strip(".,;:!?\"'()«»“”„’…") for w in text.lower().split()]
        return max(sum(w in s for w in words) / max(len(words), 1) for s in which)
    running = " ".join(t for t, n in paragraphs if len(t) >= rules.short and n <= rules.link_share * len(t))
    fitting = [s for s in lists if stops(running, [s]) >= rules.stop_fit]
    labels = []
    for t, n in paragraphs:
        share, sw = n / len(t), stops(t, fitting or lists)
        if "\xa9" in t and len(t) < rules.long or share > rules.link_share:
            labels.append("bad")
        elif len(t) < rules.short:
            labels.append("bad" if n else "short")
        elif not fitting or sw >= rules.stop_high and len(t) > rules.long:
            labels.append("good")
        else:
            labels.append("bad" if fitting and sw < rules.stop_low and n else "near")
    firm = [x if x in ("good", "bad") else None for x in labels]
    def stays(i):
        if firm[i]:
            return firm[i] == "good"
        left = next((x for x in firm[:i][::-1] if x), None)
        right = next((x for x in firm[i + 1:] if x), None)
        if "good" not in firm and labels[i] == "near":
            return True
        if left is None and right is None:
            return labels[i] == "near" or not any(firm)
        if left is None or right is None or left == right:
            return "good" in (left, right)
        return labels[i] == "near"
    return "\n".join(t for i, (t, _) in enumerate(paragraphs) if stays(i))


def test_main_text_equals_the_rules_spelled_out():
    rnd = random.Random(11)
    common = html_text.STOP_WORDS["en"].split()
    for _ in range(400):
        page, paragraphs = [], []
        for _ in range(rnd.randint(1, 9)):
            density, n = rnd.choice((0, 0.05, 0.15, 0.5)), rnd.choice((1, 3, 12, 30, 60))
            words = [rnd.choice(common) if rnd.random() < density else f"w{rnd.randint(0, 99)}" for _ in range(n)]
            words += ["\xa9"] * (rnd.random() < 0.1)
            cut = rnd.choice((0, 0, 0, len(words) // 4, len(words)))
            link = " ".join(words[:cut])
            page.append("<p>" + (f"<a href=x>{link}</a> " if cut else "") + " ".join(words[cut:]) + "</p>")
            paragraphs.append((" ".join(words), len(link)))
        assert html_text.main_text("".join(page)) == _block_rules(paragraphs)


@pytest.mark.parametrize("text, names", [
    ("Mary Smith left. Smith returned; Mary smiled.", "Mary Smith Smith Mary"), ("Jane Doe and Priya Patel", "Jane Doe Priya Patel"),
    ("Ms O’Neill spoke", "O’Neill"), ("Sir Keir spoke", "Keir"), ("on James Bond Street", ""), ("Mr. President spoke", ""),
    ("Robert Brown has brown hair. Brown eyes, too.", "Robert Brown"), ("SMITH wrote. Mr Smith too.", "SMITH Smith"),
    ("Smith & Co. Then Mr Smith, Smithson, McSmith", "Smith Smith")])
def test_repeat_mentions_and_what_is_no_name(text, names):
    assert " ".join(text[e.start:e.end] for e in pii.detect(text)) == names


@pytest.mark.parametrize("text, kinds", [
    ("call 020 7946 0958 now", "phone"), ("0171 234 5678", "phone"), ("at 2001:db8:85a3::8a2e:370:7334.", "ip6"),
    ("fe80:0:0:0:200:f8ff:fe21:67cf", "ip6"), ("at 12:30:45 or ::1", ""), ("std::vector a::b", ""), ("0.123 456 7890", ""),
    ("2024-01-02 030 40", "")])
def test_national_phones_and_addresses(text, kinds):
    found = pii.detect(text)
    assert ",".join(e.kind for e in found) == kinds
    for e in found:
        new = pii.dress(text[e.start:e.end], e.kind, pii.surrogate(b"k", e.kind, e.canonical, e.shape))
        assert new != text[e.start:e.end] and [x.kind for x in pii.detect(new)] == [e.kind]


def _overlap_free(found):
    """Greedy choice, in order, spelled out."""
    taken = []
    for e in found:
        if all(e.end <= t.start or t.end <= e.start for t in taken):
            taken.append(e)
    return sorted(taken, key=lambda e: e.start)


def test_detection_equals_its_parts_spelled_out():
    rng = random.Random(12)
    bits = ["Mr", "Mrs.", "Smith", "Jones", "Mary", "John", "smith", "Mary-Ann", "O'Neil", "met", "a.b@example.com", "1.2.3.4",
            "4565410125667261", "+49 30 1234567", "123-45-6789", "DE89 3704 0044 0532 0130 00", "and", "Street", ".", "2001:db8::1"]
    for _ in range(1500):
        text = " ".join(rng.choice(bits) for _ in range(rng.randint(2, 14)))
        names = pii._names(text)
        patterns = []
        for kind, pattern in pii.PATTERNS:
            for m in pattern.finditer(text):
                one = [e for e in pii.detect(m.group()) if e.kind == kind and (e.start, e.end) == (0, len(m.group()))]
                patterns += [pii.Entity(m.start(), m.end(), kind, e.canonical, e.shape) for e in one]
        want = _overlap_free([*patterns, *sorted(names, key=lambda e: (e.start, e.end)), *pii._again(text, names)])
        assert pii.detect(text) == want, text


@pytest.mark.parametrize("bit", ["Mary Smith met Mr Jones. ", "John ", "a@b.cd ", "1.2.3.4 ", "Mr ", "+49 30 1234567 ", "0171 234 ", "a:b:", "Smith-"])
def test_long_texts_take_time_in_proportion(bit):
    def seconds(n):
        start = time.process_time()
        pii.detect(bit * (n // len(bit)))
        return time.process_time() - start
    seconds(20_000)
    assert seconds(240_000) < 12 * max(seconds(60_000), 0.02)
