"""Properties of the kernels on generated inputs."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.llm import chat, packing, pii, substrings
from fieldloom.llm import components as graph_components
from fieldloom.llm.components import forest
from fieldloom.llm.parsing import Parse, Rolling, anchors, parse_ranks, sliding_min, suffix_ranks
from fieldloom.llm.trigrams import compile_query

from .helpers import components, personal_spans

few = st.text(alphabet="ab", max_size=60)
CASES = settings(max_examples=150, deadline=None)


@CASES
@given(st.text(alphabet="<>/s[]INSTROLE\\ x", max_size=40))
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)


@CASES
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "tool", "", "[/ROLE]"]), st.text(alphabet="<>/s[]INST\\ x", max_size=20)), max_size=6))
def test_reading_back(turns):
    from fieldloom.llm.templates import compile_template

    pieces = compile_template(chat.TEMPLATE, chat.escape)({"messages": [{"role": r, "text": t} for r, t in turns]})
    assert chat.read_back("".join(x for x, _ in pieces)) == turns
    assert "".join(chat.unescape(x) for x, marked in pieces if marked) == "".join(t for r, t in turns if r == "assistant")


@CASES
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=80), st.integers(1, 20))
def test_sliding_min(values, width):
    v = np.array(values, np.uint64)
    assert sliding_min(v, width).tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]
    at = anchors(v, width)
    assert all(i <= a < i + width for i, a in enumerate(at))


@CASES
@given(st.lists(st.binary(max_size=24), min_size=1, max_size=12))
def test_suffix_ranks(strings):
    data = np.frombuffer(b"".join(strings), np.uint8)
    start = np.cumsum([0, *map(len, strings[:-1])])
    ranks = suffix_ranks(data, start, np.array([len(s) for s in strings]))
    ordered = sorted(strings)
    assert ranks.tolist() == [ordered.index(s) for s in strings]


@CASES
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40))
def test_parse_ranks(values):
    ranks = parse_ranks(np.array(values), 64)
    suffixes = [values[i:] for i in range(len(values))]
    assert np.argsort(ranks, kind="stable").tolist() == sorted(range(len(values)), key=lambda i: suffixes[i])


@CASES
@given(st.lists(few.map(str.encode).filter(lambda t: len(t) >= 8), min_size=1, max_size=6))
def test_repeated_strings(texts):
    length = 8
    parse = Parse(texts, Rolling(5), width=3, one_in=4)
    positions = np.concatenate([np.arange(s, e - length + 1) for s, e in zip(parse.starts, parse.ends, strict=True)])
    whole = b"".join(texts)
    every = [whole[p : p + length] for p in positions]
    assert parse.repeated(positions, length).tolist() == [every.count(x) > 1 for x in every]


@CASES
@given(st.lists(few.map(str.encode), max_size=5))
def test_ranges_cover_every_position_once(texts):
    seen = []
    for x in substrings.ranges(texts, 30, 8):
        for t, low, high in zip(x["text"], x["low"], x["high"], strict=True):
            seen += [(int(t), p) for p in range(low, high + 1)]
    assert sorted(seen) == [(k, p) for k, t in enumerate(texts) for p in range(len(t) - 29)]


@CASES
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), max_size=30))
def test_forest(links):
    a, b = forest(np.array([x for x, _ in links], np.int64), np.array([y for _, y in links], np.int64))
    roots = components(21, links)
    named = dict(zip(a.tolist(), b.tolist(), strict=True))
    assert all(named.get(x, x) == roots[x] for pair in links for x in pair)


@CASES
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 5))
def test_boundaries(bins, k):
    lengths = sorted(bins)
    found = packing.boundaries(np.array(lengths), np.array([bins[n] for n in lengths]), k)
    assert found == sorted(set(found)) and len(found) <= k and found[-1] == lengths[-1]


@CASES
@given(st.text(alphabet="a1.@+-% ()5", max_size=60))
def test_base_spans(text):
    want = personal_spans(text)
    assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == [(k, a, b) for a, b, k in want]


@CASES
@given(st.text(alphabet="abcxyz", max_size=30))
def test_trigram_queries_never_miss(text):
    for pattern in (r"(abc|abx)y?z+", r"a[bc]{2,3}x", r"(ab)+c", r"x(yz|abc)*a", r"(?i:ABC)x"):
        query = compile_query(pattern)
        holds = lambda q: q.kind == "any" or (q.tri in text if q.kind == "tri" else (all if q.kind == "and" else any)(map(holds, q.parts)))  # noqa: B023, E731
        if re.search(pattern, text):
            assert holds(query)


@given(st.text(alphabet="a1@. \t\n\x1f\xa0:é" + "b" * 20, max_size=300), st.integers(1, 200))
def test_patterns_of_any_span_are_among_the_places(text, stretch):
    text = text.replace("b", "b" * stretch)
    every = {p for x in pii.places(text, pii.Codes()) for p in x.tolist()}
    around = pii.Around(text)
    spans = pii.base_spans(text)
    for a, b in sorted([(a, b) for _, a, b in spans] + pii.identifiers(text, spans)):
        assert set(around.patterns(a, b)) <= every


def test_few_edges_end_in_one_task_and_rounds_agree(spark):
    rng = np.random.default_rng(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(int(a), int(b)) for a, b in rng.integers(0, 90, (60, 2))]
    edges = spark.createDataFrame(links, "a long, b long").repartition(4)
    found, jobs = [], []
    for most in (graph_components.TASK_EDGES, 0):
        spark.sparkContext.setJobGroup(f"components-{most}", "")
        found.append({(r["node"], r["root"]) for r in graph_components.components(edges, most=most).collect()})
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{most}")))
    spark.sparkContext.setJobGroup("others", "")
    assert found[0] == found[1] and (160, 100) in found[0]
    assert jobs[0] <= 8 < jobs[1]
