"""Filter audit, product codes and benchmark passages against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.llm import audit, decontamination, productcodes

from .helpers import CLASHING, documents, odd_texts, sha, words

# --- filter audit


def failing(text: str, copy: bool) -> str:
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text))
    return out + "D" * bool(re.search(r"[#$%&*|]", text)) + "E" * copy


def audited(rows, labels):
    """rows: doc_id, text, lang."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    fails = [failing(t or "", i is not None and i > first[t or ""]) for i, t, _ in rows]
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    shapley = Counter()
    for order in map("".join, permutations("ABCDE")):
        for step, f in enumerate(order):
            for (i, _, lang), bad in zip(rows, fails, strict=True):
                c = out.setdefault((lang or "", order, step + 1), [0] * 6)
                gone, mine = bool(set(order[:step]) & set(bad)), f in bad
                for k, x in enumerate((not gone and not mine, not gone and mine, gone and mine, bad == f, not gone and mine and i in good, not gone and mine and i in toxic)):
                    c[k] += x
                shapley[lang or "", f] += not gone and mine
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows():
    rng = random.Random(3)
    plain = words(rng, 260)
    texts = [*odd_texts(), plain, plain, plain, plain[:63] + "#" + plain[64:], plain + " ", "ABC " * 220, "x|y", plain[:1500], plain[:1500], plain[:100] + plain[101:], plain[1:]]
    texts += ["same head " * 10 + f"end{k % 3}" for k in range(9)]
    ids = [*range(len(texts) - 3), None, 4, 4]
    return [(i, t, (None, "en", "de", "")[k % 4]) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.mark.parametrize("bits", [64, 1, 3])
def test_audit_equals_brute_force(spark, bits):
    """With few bits of digest different texts share classes; texts tell them apart."""
    rows = audit_rows()
    labels = [(i, k % 2, k % 3 == 0) for k, (i, *_) in enumerate(rows)] + [(1, 1, 1), (1, 0, 0), (None, 1, 1), (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).withColumns({c: F.lit("x") for c in (*CLASHING, "mask", "part", "length", "blocks", "first")})
    told = spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int").withColumn("part", F.lit(0))
    found = audit.interactions(docs, told, bits)
    assert {tuple(r) for r in found.collect()} == audited(rows, labels)


def test_audit_of_nothing_and_without_labels(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(docs, labels).count() == 0
    one = audit.interactions(docs.unionByName(spark.createDataFrame([(1, None, None)], docs.schema)), labels).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(r["part"], r["step"], r["removed"], r["shapley"]) for r in one] == [("", 1, 1, 120), ("", 2, 0, 0), ("", 3, 0, 0), ("", 4, 0, 0), ("", 5, 0, 0)]


def test_refinement_drops_what_is_alone(spark):
    """Only texts that occur twice are compared whole."""
    rng = random.Random(5)
    texts = [words(rng, 300)[:1700] for _ in range(40)]
    docs = documents(spark, [*texts, texts[3], texts[3], texts[8]])
    rows = audit._hashed(docs)
    assert audit.refined(rows.select("length", "blocks")).count() == 2


@given(st.text(alphabet="ab Z#é\n\t", max_size=40), st.integers(1, 10))
def test_failures_of_any_text(text, step):
    bits = audit.failures(text.encode(), step)
    assert "".join(f for k, f in enumerate("ABCD") if bits >> k & 1) == failing(text, False)


def test_passed_filters(spark):
    rows = audit_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert audit.passed(docs, "AD").count() == sum(not set("AD") & set(failing(t or "", False)) for _, t, _ in rows)


# --- product codes


def whole(vectors, scale=1024):
    return [[math.floor(scale * float(np.float32(x))) for x in v] for v in vectors]


def coded(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, whole vector, label), in order of vec_id. Returns (codes and errors), codebooks."""
    width = len(rows[0][1]) // parts
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    books = [[cut(v, p) for _, v, _ in rows[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for _, v, _ in rows:
                got.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [tuple(sum(c) // len(c) for c in zip(*got[k], strict=True)) if k in got else e for k, e in enumerate(books[p])]
    found = [[near(cut(v, p), books[p]) for p in range(parts)] for _, v, _ in rows]
    return [("".join(f"{k:02x}" for _, k in x), sum(d for d, _ in x)) for x in found], books


SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, v string"


def vector_rows(spark, vectors, labels, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, c, "x", "y", "z") for i, v, c in zip(ids, vectors, labels, strict=True)], SCHEMA)


@pytest.mark.parametrize(("scale", "block", "entries"), [(1.0, 1024, 256), (1.0, 7, 16), (1e3, 50, 16), (1e5, 50, 9), (1e15, 50, 5)])
def test_codes_equal_brute_force(spark, scale, block, entries):
    """Small, middling and large components: whole numbers of 32 and 64 bits and of any size."""
    rng = np.random.default_rng(2)
    x = (scale * rng.normal(size=(120, 8))).astype(np.float32)
    x[40:70] = x[3]  # copies, so that entries repeat and some stay unused
    vectors = [list(map(float, v)) for v in x]
    labels = [None if k % 5 == 0 else k % 3 for k in range(len(vectors))]
    odd = [None, [math.nan] * 8, [math.inf] + [0.0] * 7, [None] + [1.0] * 7]
    frame = vector_rows(spark, [*vectors, *odd], [*labels, 1, 1, 1, 1]).repartition(5)
    want, books = coded([(k, v, c) for k, (v, c) in enumerate(zip(whole(vectors), labels, strict=True))], entries=entries)
    if max(e for _, e in want) >= 1 << 63:
        with pytest.raises(Exception, match="(?i)overflow|out of bounds|too large"):
            productcodes.compress(frame, block=block, entries=entries)[0].collect()
        return
    rows, found = productcodes.compress(frame, block=block, entries=entries)
    assert [[tuple(e) for e in p] for p in found.tolist()] == books
    sums = Counter()
    for (_, e), c in zip(want, labels, strict=True):
        sums[c] += e
    line = ",".join(str(v) for p in books for e in p for v in e)
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in rows.collect()}
    assert got == {k: (*x, sums[c], hashlib.sha256(line.encode()).hexdigest()) for k, (x, c) in enumerate(zip(want, labels, strict=True))}


def test_codes_of_odd_lengths_repeated_ids_and_nothing(spark):
    assert productcodes.compress(vector_rows(spark, [], []))[0].count() == 0
    frame = vector_rows(spark, [[1.0, 2.0, 3.0, 4.0], [], [1.0] * 5, [0.0] * 8, [1.0, 2.0, 3.0, 5.0], [9.0] * 4], [1, 1, 2, None, 1, 3], [7, 0, 1, 8, 7, None])
    rows, books = productcodes.compress(frame)
    assert books.shape == (4, 3, 1) and books[3].ravel().tolist() == [4096, 5120, 9216]
    got = sorted((r["vec_id"] is None, r["vec_id"], r["code"], r["error"], r["label_error"]) for r in rows.collect() if r["code"])
    assert got == [(False, 7, "00000000", 0, 0), (False, 7, "00000001", 0, 0), (True, None, "02020202", 0, 0)]
    assert sorted(r["vec_id"] for r in rows.collect() if r["code"] is None) == [0, 1, 8]


def test_decoded_vectors_are_as_near_as_their_error_says(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    rows, books = productcodes.compress(vector_rows(spark, [list(map(float, v)) for v in x], [0] * 300), entries=64)
    back = {r["vec_id"]: np.array(r["vector"]) for r in productcodes.decoded(rows, books).collect()}
    for r in rows.collect():
        assert abs(np.linalg.norm(back[r["vec_id"]] - x[r["vec_id"]]) - math.sqrt(r["error"]) / 1024) < 4 * 2 / 1024


def test_tensors_merge_in_any_order():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(-99, 99, (8, n)) for n in (5, 1, 30, 12)]
    books = rng.integers(-99, 99, (4, 6, 2))
    each = [productcodes._added(None, b, books) for b in blocks]
    whole_table = productcodes._added(None, np.concatenate(blocks, axis=1), books)
    for order in permutations(each):
        merged = None
        for t in order:
            merged = productcodes._merged(merged, t)
        assert all((a == b).all() for a, b in zip(merged, whole_table, strict=True))


# --- benchmark passages


def low(text: str) -> list[str]:
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def leaks(texts, items, size=10):
    windows = {}
    for i, t in items:
        w = low(t or "")
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for t in texts:
        w, hit, ids = low(t or ""), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if (found := windows.get(tuple(w[k : k + m]))) is not None:
                    hit |= set(range(k, k + m))
                    ids |= {str(i) for i in found if i is not None}
        out.append((len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return out


def leaking():
    rng = random.Random(9)
    passage, other = words(rng, 40), words(rng, 25)
    items = [(0, passage), (1, other.upper()), (2, "Three, short words"), (10, None), (11, " ., "), (2, other), (None, "no id here"), (3, "é ü"), (30, passage)]
    w = passage.split()
    texts = [*odd_texts(), passage, "--".join(w[3:20]), " ".join(w[:9]), "x " + other + " y " + passage, "three short. WORDS no id\nhere three short words", "É é ü!", " ".join(w[5:15]) + " " + " ".join(w[6:16])]
    texts += [words(rng, 300) + " " + passage + " " + words(rng, 500) + " three short words", "a" * 500 + " " + passage + "b", ("no id here " * 40), passage + "\x00" + other]
    return texts, items


@pytest.mark.parametrize(("portion", "step"), [(1 << 26, 1 << 20), (400, 1 << 20), (1 << 26, 64), (300, 50)])
def test_leaks_equal_brute_force(spark, portion, step):
    texts, items = leaking()
    ids = [*range(len(texts) - 2), None, 3]
    docs = documents(spark, texts, ids, extra=True).withColumn("items", F.lit(1)).repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit("x"))
    found = decontamination.report(decontamination.scan(docs, benchmark, portion=portion, step=step))
    assert Counter(tuple(r) for r in found.collect()) == Counter((i, *x) for i, x in zip(ids, leaks(texts, items), strict=True))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet="aB 1.é", max_size=40), max_size=5), st.lists(st.text(alphabet="ab 1.é", max_size=12), max_size=4), st.integers(1, 30))
def test_scan_of_any_texts(texts, items, step):
    windows = {}
    for k, t in enumerate(items):
        for x in decontamination.windows_of(t.encode(), 3):
            windows.setdefault(x, []).append(str(k))
    scans = decontamination.scanned([t.encode() for t in texts], decontamination.lookups(list(windows.items())), step)
    got = [(s.words, s.hit, len(s.items), sha(",".join(sorted(s.items))), s.hit > 0) for s in scans]
    assert got == leaks(texts, list(enumerate(items)), 3)
    for s, t in zip(scans, texts, strict=True):
        assert sum(len(low(t.encode()[a:b].decode())) for a, b in s.spans) == s.hit


def test_leaks_without_documents_or_benchmark(spark):
    docs = documents(spark, ["some text here", None])
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert [(r["n_words"], r["n_hit"]) for r in decontamination.scan(docs, nothing).orderBy("doc_id").collect()] == [(3, 0), (0, 0)]
    assert decontamination.scan(docs.limit(0), nothing).count() == 0


def test_clean_removes_spans_or_documents(spark):
    texts, items = leaking()
    docs = documents(spark, [*texts, texts[-1]], extra=True)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    dirty = {t for t, x in zip(texts, leaks(texts, items), strict=True) if x[-1]}
    whole_docs = decontamination.clean(docs, benchmark, "documents")
    assert whole_docs.columns == docs.columns
    assert Counter(r[-4] for r in whole_docs.collect()) == Counter(t for t in texts if t not in dirty)
    spans = decontamination.clean(docs, benchmark)
    assert spans.count() == docs.count()
    kept = [r[-4] for r in spans.collect()]
    assert Counter(t for t in kept if t and t in set(texts)) == Counter(t for t in texts if t and t not in dirty)
    assert "three short words" not in " ".join(t or "" for t in kept)
    assert decontamination.scan(spans.select(F.col("doc_id"), F.col("text")), benchmark).where("n_hit > 0").count() <= 1
