"""Documents with every odd case, and the brute force of the contracts."""

from __future__ import annotations

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use for themselves.
CLASHING = ("key", "check", "size", "digest", "row", "spans", "copies", "rank", "fp", "score", "kinds", "held_out")


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def documents(spark, texts, ids=None, extra=False):
    """One row a text; with extra=True more columns, named to clash."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", None if k % 7 == 3 else f"s{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    frame = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        frame = frame.select(*[F.lit("x").alias(c) for c in CLASHING], *frame.columns)
    return frame


def odd_texts() -> list:
    """Null, empty, white space, one word, copies, near copies, a long text, non-ASCII letters."""
    rng = random.Random(7)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    long = words(rng, 9000)
    return [None, "", " \t\n", "one", base, base, " ".join(near), long, long + " end", "Éà ü ß " * 40, words(rng, 30), None, ""]


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def secret_spans(text: str):
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), m.end(), "assign") for m in a.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ("assign", "access", "hex")
    return sorted(out, key=lambda x: (x[0], order.index(x[2])))


def personal_spans(text: str):
    digits = lambda x: re.sub("[^0-9]", "", x)

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


def components(n: int, links) -> list[int]:
    """The least member of each one's component."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
