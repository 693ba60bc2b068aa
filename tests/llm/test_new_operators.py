"""Operators 11 to 13 beside brute-force versions and exact round trips, on small tables with odd rows."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import periodic_runs, pii_spans, spelling_variants, warc_archives

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, word string, runs int, root string"


def documents(spark, rows):
    """Documents with further columns whose names the operators use for results."""
    return spark.createDataFrame([(i, t, "w", 3, "r") for i, t in rows], SCHEMA).repartition(3)


# 11


def brute_vocabulary(rows, divisor):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if divisor and h % divisor == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows, divisor):
    n = brute_vocabulary(rows, divisor)
    around = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(around[w]), None if form[w] is None else n[form[w]])
    return out


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(11)
    bases = ["".join(rng.choice("abcdéÿß×") for _ in range(rng.randint(6, 11))) for _ in range(25)] + ["q" * 9, "l" * 70, "l" * 134, "Zebra" * 30]
    words = []
    for base in bases:
        words += [base] * rng.choice([5, 30, 200])
        for _ in range(8):
            i, c = rng.randrange(len(base)), rng.choice("abcdéÿ÷zÀ")
            other = rng.choice([base[:i] + base[i + 1:], base[:i] + c + base[i:], base[:i] + c + base[i + 1:]])
            words += [other] * rng.choice([1, 4, 5, 6, 40])
    words += ["chains"] * 200 + ["chainz"] * 30 + ["chainzé"] * 6
    rng.shuffle(words)
    words = [w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words]
    rows = [(i, rng.choice([" ", "-1", "\n"]).join(words[i::40])) for i in range(40)]
    return rows + [(100, None), (101, ""), (102, "  \t"), (None, "noname noname Nonamé"), (3, rows[3][1]), (103, "漢字 тест noname nonamee" * 3)]


@pytest.mark.parametrize("divisor", [None, 3])
def test_spelling_variants(spark, spelled, divisor):
    got = spelling_variants.variants(documents(spark, spelled), divisor=divisor).collect()
    want = brute_variants(spelled, divisor)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want and len(got) == len(want)
    assert sum(v[0] is not None for v in want.values()) > 10 and any(v[0] is not None and v[0] != v[1] for v in want.values())


def test_spelling_filters_in_many_rounds(spark, spelled):
    """Filters of a few blocks a round: lengths are split in parts, and the groups stay the same."""
    words = spelling_variants.vocabulary(documents(spark, spelled))
    sizes = collections.Counter(int(spelling_variants.shard_of(np.array(len(w)))) for w in brute_vocabulary(spelled, None))
    rounds = spelling_variants.plan_rounds(sizes, 32)
    assert len(rounds) > 3 and any(s.parts > 1 for r in rounds for s in r.slots.values()) and max(r.blocks for r in rounds) == 1
    got = {r["word"]: r["root"] for r in spelling_variants.group(words, filter_bytes=32).collect()}
    assert got == {w: v[1] for w, v in brute_variants(spelled, None).items()}


def test_spelling_edits_are_all_probed():
    """With filters that hold everything, every deletion and every later replacement is a positive, once."""
    word, other = "abcaab", "zzzzzz"
    rounds = spelling_variants.plan_rounds({5: 1, 6: 1})
    lanes = np.full((rounds[0].blocks, 8), 0xFFFFFFFF, np.uint32)
    found = [int(d) for n, ds in spelling_variants.positives([other, word], rounds[0], lanes) for i, d in zip(n, ds) if i == 1]
    letters = [chr(c) for c in spelling_variants.ALPHABET]
    edits = {word[:i] + word[i + 1:] for i in range(6)} | {word[:i] + c + word[i + 1:] for i in range(6) for c in letters if c > word[i]}
    assert sorted(found) == sorted(int(d) for d in spelling_variants.digests(sorted(edits)))


def test_spelling_of_long_texts_and_words():
    text = ("Wort" * 400_000 + " kurze Worte ") * 2
    assert spelling_variants.words_of(text) == {"wort" * 400_000: 2}
    digest = spelling_variants.digests(["wort" * 400_000])
    assert digest[0] == spelling_variants.digests(["xyz", "wort" * 400_000])[1]


def test_spelling_of_empty_tables(spark, spelled):
    frame = documents(spark, spelled)
    assert spelling_variants.variants(frame.limit(0)).count() == 0
    got = spelling_variants.respelled(frame, spelling_variants.variants(frame))
    assert got.columns == [*frame.columns, "spellings"] and got.count() == frame.count()
    by = {r["doc_id"]: r["spellings"] for r in got.collect()}
    assert by[100] == [] and any(s["root"] != s["word"] for found in by.values() for s in found)


# 12


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(
                    all(words[t] == words[t + p] for t in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_periodic(doc_id, text, edited):
    words = WORD.findall(text or "")
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if edited and h % 10 == 0 and n > 0:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    dropped = {t for s, length, q in runs for t in range(s + q, s + length)}
    kept = " ".join(w for t, w in enumerate(words) if t not in dropped)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *((None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])),
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def repeating_texts():
    rng = random.Random(12)
    rows = []
    for i in range(120):
        words = []
        while len(words) < rng.choice([5, 40, 150]):
            unit = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.choice([1, 1, 2, 3, 5, 6, 7, 18, 19, 25]))]
            words += unit * rng.choice([1, 2, 4, 5]) + unit[:rng.randint(0, len(unit))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows + [(200, None), (201, ""), (202, " \r\n"), (203, "one"), (None, "x y " * 9), (5, rows[5][1]), (204, "A a " * 5), (205, "é è " * 30 + "é")]


@pytest.mark.parametrize("edited", [False, True])
def test_periodic_runs(spark, edited):
    rows = repeating_texts()
    got = sorted(map(tuple, periodic_runs.runs(documents(spark, rows), edited=edited).collect()), key=str)
    assert got == sorted((brute_periodic(i, t, edited) for i, t in rows), key=str)
    assert sum(r[1] for r in got) > 100 and {r[4] for r in got} >= {1, 2, 5, 6, 7}


def test_periodic_runs_of_random_words():
    """Many short alphabets and long periods, straight on the function: the documents of a batch do not mix."""
    rng = random.Random(1)
    for trial in range(60):
        texts = []
        for _ in range(4):
            words = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.7:
                unit = [rng.randrange(9) for _ in range(rng.choice([4, 17, 18, 19, 57, 58, 60]))]
                words += unit * 4 + unit[:rng.randrange(3)]
            texts.append(words)
        ids = np.array([w for t in texts for w in t], np.int64)
        got = periodic_runs.runs_of(ids, np.cumsum([len(t) for t in texts]))
        assert [[(r.start, r.length, r.period) for r in row] for row in got] == [brute_runs(t) for t in texts]


def test_periodic_runs_of_a_frequent_word_take_linear_work():
    ids = np.zeros(200_000, np.int64)
    places, lags = periodic_runs.seeds(ids, np.array([200_000]), 5, 1)
    assert len(places) < 200_000 and set(lags.tolist()) == {1}
    assert periodic_runs.runs_of(ids, np.array([200_000])) == [[periodic_runs.Run(0, 200_000, 1)]]


def test_collapsed_documents(spark):
    frame = documents(spark, [(1, "go " * 8 + "home"), (2, "no  runs here"), (3, None), (None, "")])
    got = {r["doc_id"]: r for r in periodic_runs.collapsed(frame).collect()}
    assert got[1]["text"] == "go home" and [tuple(r) for r in got[1]["runs"]] == [(0, 8, 1)]
    assert got[2]["text"] == "no  runs here" and got[3]["text"] is None and got[3]["word"] == "w"
    assert periodic_runs.collapsed(frame.limit(0)).count() == 0 and periodic_runs.runs(frame.limit(0)).count() == 0


# 13


def pages(spark):
    rows = [(i, f"http://x.example/{i}", f"<p>{i % 7}</p>" * (i % 3 + 1)) for i in range(60)]
    rows += [(100, None, None), (101, "u", ""), (102, "a\r\nb", "é漢😀\r\n\r\nWARC/1.1\r\n"), (103, "long", "xyz" * 900_000), (None, "n", "<p>0</p>"),
             (None, "n", "alone"), (104, "same", "twice"), (104, "same", "twice"), (-5, "neg", "neg")]
    return spark.createDataFrame([(*r, "mine", 7) for r in rows], "page_id long, url string, html string, record_type string, offset int").repartition(4), rows


@pytest.mark.parametrize("least", [0, 20])
def test_warc_round_trip(spark, least):
    frame, rows = pages(spark)
    largest = collections.defaultdict(lambda: None)
    for i, _, html in rows:
        if i is not None:
            largest[html or ""] = i if largest[html or ""] is None else max(i, largest[html or ""])
    want = []
    for i, _, html in rows:
        data, top = (html or "").encode(), largest[html or ""]
        again = len(data) >= least and top is not None and i != top
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", top if again else None))
    got = warc_archives.round_trip(frame, least)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_warc_files(spark, tmp_path):
    """One member per record at the index's offsets, the sidecar beside, payloads as given."""
    frame, rows = pages(spark)
    archives = warc_archives.write(frame, f"{tmp_path}/whole")
    assert sum(r["records"] for r in archives.collect()) == len(rows)
    for r in archives.collect():
        with open(r["archive"], "rb") as f:
            engine = zlib.decompressobj(31)
            engine.decompress(f.read())
            assert engine.eof and not engine.unused_data
    index = warc_archives.normalise(archives, f"{tmp_path}/records")
    assert index.where("complete").count() == len(rows)
    for r in index.collect():
        with open(r["archive"], "rb") as f:
            data = f.read()
        record = gzip.decompress(data[r["offset"]:r["offset"] + r["length"]])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and f"WARC-Record-ID: {r['record_id']}".encode() in record
        with open(r["archive"].removesuffix(".warc.gz") + ".cdxj") as f:
            assert sum(1 for line in f if f'"offset": {r["offset"]},' in line) == 1
    back = warc_archives.read_back(index).where("record_type = 'response'").collect()
    by = collections.defaultdict(set)
    for i, _, html in rows:
        by[i].add((html or "").encode())
    assert all(bytes(r["payload"]) in by[r["page_id"]] for r in back)
    assert next(r["uri"] for r in back if r["page_id"] == 102) == "a%0D%0Ab"
    assert warc_archives.round_trip(frame.limit(0)).count() == 0


def normalised(data):
    out = io.BytesIO()
    entries, complete = warc_archives.normalise_stream(io.BytesIO(data).read, out.write)
    return entries, complete, out.getvalue()


def test_warc_streams_of_every_kind():
    records = [warc_archives.encode(i, "u", b"x" * n, "D" * 32, None, False) for i, n in enumerate((0, 5, 3_000_000))]
    whole = gzip.compress(b"".join(records))
    for data in (whole, b"".join(map(gzip.compress, records)), b"".join(records), gzip.compress(records[0]) + gzip.compress(records[1] + records[2])):
        entries, complete, out = normalised(data)
        assert complete and [gzip.decompress(out[e["offset"]:e["offset"] + e["length"]]) for e in entries] == records
    entries, complete, _ = normalised(gzip.compress(b"".join(records), 0)[:2_000_000])
    assert not complete and [e["record_id"] for e in entries] == ["<urn:page:0>", "<urn:page:1>"]
    for bad in (gzip.compress(records[0] + b"junk that is no record\r\n\r\n"), whole[:-4], records[0][:40], gzip.compress(re.sub(rb"Content-Length: \d+(?=\r\n\r\nHTTP)", b"Content-Length: x", records[0]))):
        assert not normalised(bad)[1]
    assert normalised(b"") == ([], True, b"")


def test_warc_index_of_broken_archives(spark, tmp_path):
    (tmp_path / "broken.warc.gz").write_bytes(b"\x1f\x8bnot gzip")
    frame = spark.createDataFrame([(f"{tmp_path}/broken.warc.gz",)], "archive string")
    got = warc_archives.normalise(frame, f"{tmp_path}/out").collect()
    assert len(got) == 1 and got[0]["offset"] is None and not got[0]["complete"]
    assert warc_archives.read_back(warc_archives.normalise(frame, f"{tmp_path}/out2")).count() == 0


def test_warc_digests_in_base32(spark):
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(20)]
    got = spark.createDataFrame([(h,) for h in hexes], "h string").select("h", warc_archives.base32_of_hex(F.col("h")).alias("b")).collect()
    assert all(r["b"] == base64.b32encode(bytes.fromhex(r["h"])).decode() for r in got)


# 8


def test_personal_data_in_hostile_and_long_texts():
    """Parts of ten thousand digits end, and a megabyte with ten thousand disguised contacts takes time in proportion."""
    assert pii_spans.plain_spans("x 1.2.3." + "0" * 10_000 + "1 y") == [(2, 10_009, "ip")]
    assert pii_spans.plain_spans("1.2.3." + "9" * 10_000) == []
    line = "\u0420\u0443\u0441\u0441\u043a\u0438\u0439 \u0442\u0435\u043a\u0441\u0442, jane at example dot com, \u043e\u0434\u0438\u043d. "
    base, found = pii_spans.all_spans(line * 100)
    assert not base and found == [(k * len(line) + 15, k * len(line) + 38, "email") for k in range(100)]


def brute_source(parts, start, end):
    """The source range by walking all replaced places in order."""
    first, last = start, end
    for a, b, s, e in parts:
        if b <= start and not (a == b == start):
            first = start - b + e
        elif a <= start < b:
            first = s
        if b <= end and b > a or b < end:
            last = end - b + e
        elif a < end < b:
            last = e
    return first, last


def test_spans_are_mapped_back_as_by_a_walk_over_all_places():
    rng = random.Random(2)
    for _ in range(200):
        out = pii_spans.Rewritten("".join(rng.choice("abcdefg") for _ in range(40)))
        for _ in range(3):
            cuts = sorted(rng.sample(range(len(out.text) + 1), min(10, len(out.text) // 2 * 2)))
            out.replace([(a, b, rng.choice(["", "X", "YZ", "long one"])) for a, b in zip(cuts[::2], cuts[1::2]) if a < b])
            for _ in range(20):
                a, b = sorted(rng.sample(range(len(out.text) + 1), 2)) if len(out.text) > 1 else (0, len(out.text))
                assert out.source(a, b) == brute_source(out.parts, a, b)
                assert out.touched(a, b) == any(p < b and q > a or p == q and a < p < b for p, q, _, _ in out.parts)
