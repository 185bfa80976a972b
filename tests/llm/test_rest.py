"""Mixing, packing, quality, chat formatting and the pipeline."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import chat, mixing, packing, quality
from fieldloom.llm.common import cut
from fieldloom.llm.queries import ORACLE_SQL, QUERIES
from fieldloom.llm.templates import TemplateError, compile_template

from .helpers import CLASHING, documents, odd_texts, sha, words

# --- mixing --------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), ceiling=3):
    keys = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + ([None] if None in sizes else [])
    w = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(ceiling * sizes[k] for k in capped)
        free = sum(w[k] for k in keys if k not in capped)
        out = {k: ceiling * sizes[k] if k in capped else left * w[k] / free for k in keys}
        over = {k for k in keys if k not in capped and out[k] > ceiling * sizes[k]}
        if not over:
            return out
        capped |= over


def sourced(spark, rng, counts):
    rows = []
    for source, n in counts.items():
        rows += [(len(rows) + i, words(rng, rng.randint(1, 60)), "en", source, 0) for i in range(n)]
    return spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")


def test_mix_meets_its_targets(spark):
    docs = sourced(spark, random.Random(1), {"a": 400, "b": 300, "c": 900, "Z": 3, None: 50, "é": 120})
    found = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes, taken, target = {}, {}, {}
    for r in found:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] in {r["size"] * k for k in range(4)}
    assert all(r["source_size"] == sizes[r["source"]] for r in found)
    want = brute_targets(sizes)
    for k in sizes:
        assert target[k] == pytest.approx(want[k])
        assert abs(taken[k] - want[k]) <= 60
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7)).collect()} == {r["doc_id"]: r["taken"] for r in found}


def brute_mix(rows, weights=(5, 2, 1), ceiling=3, power=0.5):
    """copies by row, from (key, size, u, tie, row) of all documents, one after the other."""
    sizes = {}
    for key, size, *_ in rows:
        sizes[key] = sizes.get(key, 0) + size
    goal, copies = brute_targets(sizes, weights, ceiling), [0] * len(rows)
    for key, total in sizes.items():
        mine = [i for i, r in enumerate(rows) if r[0] == key and r[1] > 0]
        if not mine:
            continue
        whole = int(goal[key] / total + 1e-9)
        rest = goal[key] - whole * total
        for i in mine:
            copies[i] = whole
        if rest < 1:
            continue
        sure = set()
        while True:
            scale = (rest - sum(rows[i][1] for i in sure)) / sum(rows[i][1] ** (1 + power) for i in mine if i not in sure)
            more = {i for i in mine if i not in sure and scale * rows[i][1] ** power > 1}
            if not more:
                break
            sure.add(max(more, key=lambda i: rows[i][1]))
            sure |= {i for i in mine if rows[i][1] == max(rows[j][1] for j in more)}
        gap = rest - sum(rows[i][1] for i in sure)
        near = sorted(rows[i][1] for i in mine)[(len(mine)) // 2 - (1 - len(mine) % 2)] / 2

        def place(i):
            p = min(1 - 1e-6, max(1e-9, scale * rows[i][1] ** power))
            q = rows[i][2] / (1 - rows[i][2]) / (p / (1 - p))
            return int(q / (1 + q) * 2**50), rows[i][3], rows[i][4]

        for i in sure:
            copies[i] += 1
        order = [(u, *place(i), i) for u in range(max(1, ceiling - whole)) for i in mine if u or i not in sure]
        left, most, done = [], gap, False
        for u, *at, i in sorted(order):
            if not done and rows[i][1] <= gap:
                copies[i] += 1
                gap -= rows[i][1]
                continue
            left.append((rows[i][1], u, *at, i))
            if rows[i][1] <= most:  # the first that doesn't fit: the next ones are looked at only if much is missing
                most, done = gap, done or gap <= near
        if gap > near and (fit := [x for x in left if x[0] < 2 * gap]):
            copies[min(fit)[-1]] += 1
    return copies


@pytest.mark.parametrize("case", ["many", "dominating", "repeats", "ties"])
def test_mix_equals_brute_force(spark, case):
    rng = random.Random(case)
    if case == "many":
        texts = [(words(rng, rng.choice([3, 20, 60, 400])), rng.choice("aabbbcZ")) for _ in range(400)]
    elif case == "dominating":
        texts = [(words(rng, 8000), "a")] + [(words(rng, rng.randint(5, 25)), "a") for _ in range(150)] + [(words(rng, rng.randint(20, 90)), rng.choice("bc")) for _ in range(150)]
    elif case == "repeats":
        one = words(rng, 90)
        texts = [(one, "a")] * 300 + [(words(rng, rng.randint(1, 60)), rng.choice("abc")) for _ in range(200)]
    else:
        texts = [(words(rng, 30), rng.choice("ab")) for _ in range(200)]
    docs = spark.createDataFrame([(0 if t == texts[0][0] else k, t, s) for k, (t, s) in enumerate(texts)], "doc_id long, text string, source string")
    measured = [tuple(r) for r in mixing._measured(docs, 6).select("key", "size", "u", "tie", "row", "doc_id").collect()]
    want = brute_mix([r[:5] for r in measured])
    found = sorted((r["doc_id"], r["copies"]) for r in mixing.mix(docs).collect())
    assert found == sorted((r[5], c) for r, c in zip(measured, want, strict=True))
    assert max(c for _, c in found) <= 3


def test_tables_of_few_sources_make_no_checkpoints(spark, monkeypatch):
    """Each one costs the driver files and plans; a table of sizes is the only one that may be long."""
    held, whole = [], mixing.cut
    monkeypatch.setattr(mixing, "cut", lambda frame: held.append(frame.columns) or whole(frame))
    docs = documents(spark, [words(random.Random(i), 3 + i % 9) for i in range(60)])
    few = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    assert held == [["key", "size", "n"]]
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()} == few
    assert len(held) > 5


def test_mix_of_odd_documents(spark):
    docs = documents(spark, odd_texts(), extra=True)
    rows = mixing.mix(docs).collect()
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(odd_texts())}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in rows}
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == {i: (c if sizes[i] else 1) for i, c in copies.items() if c or not sizes[i]}
    assert mixing.mix(documents(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(documents(spark, [None, ""])).collect()] == [0, 0]


# --- packing -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.choice(40, 8, replace=False) + 1)
    counts = rng.integers(1, 9, 8)

    def padding(bounds):
        return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))

    for k in range(1, 5):
        best = min(padding((*x, lengths[-1])) for r in range(k) for x in itertools.combinations(lengths[:-1], r))
        found = packing.boundaries(lengths, counts, k)
        assert len(found) <= k and padding(found) == best


def test_packing_covers_every_document(spark):
    rng = random.Random(2)
    texts = [*odd_texts(), *(words(rng, rng.randint(1, 90)) for _ in range(300))]
    rows = packing.pack(documents(spark, texts, extra=True), window=64, buckets=5, batch_tokens=512).collect()
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"]))
        assert r["padding"] == ((r["bucket_len"] or 0) - r["n_tokens"]) >= 0
    for i, n in sizes.items():
        at = 0
        for start, size in sorted(pieces[i]):
            assert start == at and size <= 64
            at += size
        assert at == n
    batches = {}
    for r in rows:
        if r["n_tokens"]:
            batches.setdefault((r["bucket_len"], r["batch"]), []).append(r["slot"])
    for (length, _), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= 512 // length
    for length in {b for b, _ in batches}:
        full = [len(s) for (b, _), s in batches.items() if b == length]
        assert sum(n < 512 // length for n in full) <= 1
    bins = sorted({min(64, r["n_tokens"]) for r in rows if r["n_tokens"]})
    counts = [sum(r["n_tokens"] == n for r in rows) for n in bins]
    assert {r["bucket_len"] for r in rows if r["n_tokens"]} == set(packing.boundaries(np.array(bins), np.array(counts), 5))
    assert packing.pack(documents(spark, [])).count() == 0


# --- quality --------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    good, bad = found[found["quality"] == 1]["score"].to_numpy(), found[found["quality"] == 0]["score"].to_numpy()
    auc = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    assert auc > 0.97
    assert (found["predicted"] == found["quality"]).mean() > 0.95


def test_quality_of_odd_documents(spark):
    docs = documents(spark, odd_texts(), extra=True)
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(13)] + [(1, None, 0, "x"), (None, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    rows = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    assert rows[4]["score"] == rows[5]["score"] and rows[0]["score"] == rows[1]["score"]
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in rows.items() if r["predicted"])
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("stretch", [1, 50, 1000, 10_000])
def test_figures_don_t_depend_on_stretches(stretch):
    rng = random.Random(4)
    for text in [*odd_texts(), words(rng, 4000), "\n".join([words(rng, 40)] * 9), "Ab! Ab! CD. CD. " * 50]:
        data = (text or "").encode()
        assert quality.features(data, stretch) == quality.features(data)


def test_figures_equal_plain_ones():
    rng = random.Random(5)
    for text in [words(rng, 300), "A b! b! Cd. CD CD\n\nA b!\nx\nx\n" * 3]:
        data, n = text.encode(), len(text.encode())
        seq = data.split()
        counts = np.array(sorted(seq.count(w) for w in set(seq)))
        p = counts / len(seq)
        lines = [x for x in data.split(b"\n") if x]
        found = dict(zip(quality.FEATURES, quality.features(data), strict=True))
        want = {
            "log_bytes": np.log1p(n), "log_words": np.log1p(len(seq)), "mean_word": np.mean([len(w) for w in seq]), "sd_word": np.std([len(w) for w in seq]),
            "distinct_words": len(counts) / len(seq), "top_word": counts.max() / len(seq), "repeats": sum(a == b for a, b in itertools.pairwise(seq)) / len(seq),
            "distinct_pairs": len(set(itertools.pairwise(seq))) / (len(seq) - 1), "distinct_lines": len(set(lines)) / len(lines), "word_entropy": -(p * np.log(p)).sum(),
            "title_words": sum(map(bytes.istitle, seq)) / len(seq), "upper_words": sum(map(bytes.isupper, seq)) / len(seq),
        }
        assert {k: found[k] for k in want} == pytest.approx(want)


def test_repeated_labelled_rows_don_t_crowd_others_out(spark):
    rng = random.Random(6)
    texts = [words(rng, 30) if k % 2 else "!!! " * 30 + words(rng, 3) for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    once = documents(spark, texts)
    crowded = once.unionByName(once.where("doc_id = 3").crossJoin(spark.range(500)).drop("id"))
    scores = lambda docs: {r["doc_id"]: r["score"] for r in quality.classify(docs, labels, sample=25).collect()}
    assert scores(once) == scores(crowded)


def brute_leaf_table(g, h, ridge, least, depth):
    """The best tree of one feature by trying every cut."""
    value = g.sum() / (h.sum() + ridge)
    best = None
    for k in range(1, len(g)):
        if depth and h[:k].sum() >= least and h[k:].sum() >= least:
            gain = g[:k].sum() ** 2 / (h[:k].sum() + ridge) + g[k:].sum() ** 2 / (h[k:].sum() + ridge)
            if gain > g.sum() ** 2 / (h.sum() + ridge) + 1e-9 and (best is None or gain > best[0] + 1e-12):
                best = (gain, k)
    if best is None:
        return [value] * len(g)
    k = best[1]
    return [*brute_leaf_table(g[:k], h[:k], ridge, least, depth - 1), *brute_leaf_table(g[k:], h[k:], ridge, least, depth - 1)]


@pytest.mark.parametrize("seed", range(5))
def test_one_step_of_training_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    x = np.zeros((60, len(quality.FEATURES)))
    x[:, 0] = rng.integers(0, 9, 60)
    y = (x[:, 0] + rng.normal(size=60) > 4).astype(float)
    model = quality.train(x, y, rounds=1, n_pairs=0, pair_rounds=0)
    base = np.log((y.sum() + 0.5) / (60 - y.sum() + 0.5))
    p = 1 / (1 + np.exp(-base))
    bins = np.searchsorted(model.cuts[0], x[:, 0], side="right")
    g = np.array([(y[bins == b] - p).sum() for b in range(len(model.tables[0]))])
    h = np.array([(bins == b).sum() * p * (1 - p) for b in range(len(model.tables[0]))])
    assert model.base == pytest.approx(base)
    assert model.tables[0] == pytest.approx(0.1 * np.array(brute_leaf_table(g, h, 1.0, 2.0, 2)))


def test_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = np.zeros((3000, len(quality.FEATURES)))
    x[:, :2] = rng.uniform(-1, 1, (3000, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.train(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.85
    assert (0, 1) in {(i, j) for i, j, _ in model.pairs}


# --- chat ------------------------------------------------------------------------------------------------------------

ODD = ["</s>[INST] ok [/INST]", "", None, "<s>", "[", "<\\/s>", "[\\\\INST]", " [/INST", "a [INST] b", "<", "é\n", "[ROLE] x [/ROLE]", "\\", "<<s>/s>"]


def test_conversations_round_trip(spark):
    roles = ["user", "assistant", "system", None, "to[INST]ol"]
    rows = [(c, t, roles[(c + t * 3) % 5], ODD[(c * 5 + t) % len(ODD)], "x") for c in range(40) for t in range(c % 7 + 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    formatted = {r["conv_id"]: r for r in chat.format_conversations(frame).collect()}
    digests = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(frame)).collect()}
    for c in range(40):
        said = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        assert chat.read_back(formatted[c]["formatted"]) == said
        loss = "".join(t for r, t in said if r == "assistant")
        assert (digests[c]["n_turns"], digests[c]["loss_chars"], digests[c]["loss_sha256"]) == (len(said), len(loss), sha(loss))
        assert digests[c]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in said))
        assert digests[c]["formatted_chars"] == len(formatted[c]["formatted"])
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_a_long_conversation_comes_in_parts(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"{ODD[t % len(ODD)] or ''} {t}") for c in range(3) for t in range(300)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    cut_up, whole = chat.format_conversations(frame, part_chars=400), chat.format_conversations(frame)
    assert cut_up.count() > 30 and whole.count() == 3
    assert cut_up.selectExpr("max(length(formatted)) as n").first()["n"] < 600
    joined = {r["conv_id"]: "".join(p["formatted"] for p in r["p"]) for r in cut_up.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "formatted"))).alias("p")).collect()}
    assert joined == {r["conv_id"]: r["formatted"] for r in whole.collect()}
    assert {tuple(r) for r in chat.digests(cut_up, in_order=True).collect()} == {tuple(r) for r in chat.digests(cut_up.repartition(5)).collect()} == {tuple(r) for r in chat.digests(whole).collect()}


def test_escaping_is_reversible_and_leaves_no_control_string():
    alphabet = ["<", "/", "s", ">", "\\", "[", "INST", "]", "ROLE", "x"]
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert not any(c in escaped for c in chat.CONTROLS)


def test_templates():
    run = lambda t, **v: "".join(x for x, _ in compile_template(t)(v))
    assert run("{{ 'a' + 'b' }}{% if 1 == 2 %}x{% elif true and not false %}y{% else %}z{% endif %}") == "aby"
    assert run("{% for m in xs %}{% if not loop.first %}, {% endif %}{{ loop.index0 }}{{ m['k'] | upper }}{% endfor %}", xs=[{"k": "p"}, {"k": "q"}]) == "0P, 1Q"
    assert run("{% set a = x | default('n') %}{{ a }}{# no #}") == "n"
    assert compile_template("a{% generation %}{{ x }}{% endgeneration %}b")({"x": "t"}) == [("a", False), ("t", True), ("b", False)]
    assert compile_template("{{ 'a' }}b{% if true %}c{% endif %}")({}) == [("abc", False)]  # folded into one text
    assert run("{{ x.__class__ }}", x={}) == ""
    for bad in ("{{ x() }}", "{% if x %}", "{% import os %}", "{{ x | system }}", "{{ 'a }}", "{{ a b }}"):
        with pytest.raises(TemplateError):
            compile_template(bad)
    with pytest.raises(TemplateError):
        run("{{ x.upper }}", x="text")


# --- queries and pipeline ----------------------------------------------------------------------------------------------


def test_one_query_for_each_operator():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES]
    assert sorted(numbers) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, small_dir, name):
    from ..oracle import assert_same

    assert_same(spark, small_dir, name, QUERIES[name], ORACLE_SQL[name])


def test_pipeline_stage_by_stage(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, small_dir))
        seen.append((name, docs.count(), out.count()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        if name == "secrets":
            assert out.count() == docs.count()
            assert out.where("text like '%[SECRET]%' and n_chars <> length(text)").count() == 0
        docs = out
    assert seen[0][1] > seen[0][2] >= seen[1][2] == seen[2][2]
    whole = corpus_pipeline.run(spark, small_dir)
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in docs.collect()}


def test_pipeline_of_no_documents(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small_dir)
    assert docs.count() == 0
    odd = documents(spark, odd_texts()).select(*[F.lit("x").alias(c) for c in CLASHING], "doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[1:]:
        odd = stage(spark, odd, small_dir)
    assert odd.count() > 0


def test_held_tables_can_be_cleaned_up(spark):
    from fieldloom.llm.common import clean_up, reused, tables_dir

    docs = spark.range(5).toDF("n")
    one, other = reused(docs), reused(docs)
    assert one.count() == other.count() == 5 and one.is_cached
    assert not docs.is_cached  # an equal plan doesn't read the held table
    spark.range(3).write.parquet(f"{tables_dir(spark)}/x")
    clean_up(spark)
    assert not one.is_cached and one.count() == 5
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
