from __future__ import annotations

import pytest

#: Every name that the operators use for columns of their own, but for those they add.
CLASHES = [
    "size", "kept", "parts", "score", "passages", "target", "rate", "copies", "n", "row", "old", "shard", "slot", "found", "kinds", "chunk", "whole", "lam",
    "_row", "_row_", "_parts", "_kinds", "_own", "_times", "_score", "_passages", "_ways", "_part", "_chunk", "_text", "_stays", "_key", "component", "band", "toxic_", "spans", "n_left",
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def documents(spark, texts, sources=None):
    """Rows with extra columns whose names the operators use themselves."""
    sources = sources or ["a"] * len(texts)
    rows = [(i, t, "en", s, len(t or ""), *[f"{c} of {i}" for c in CLASHES]) for i, (t, s) in enumerate(zip(texts, sources, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def untouched(rows, added=()):
    """Whether the extra columns of ``rows``, but for those in ``added``, have the values they came with."""
    return all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in CLASHES if c not in added)


@pytest.fixture(scope="session")
def corpus():
    """Texts with nulls, empties, exact and near copies, shared passages, ties and a long text."""
    import random

    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)] + ["été", "naïve", "straße"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage, line = text(120), text(45), text(22)
    out = [None, "", "   \n\t", "one", "two words", "one", base, base, base.upper(), base + " tail", "head " + base]
    for _ in range(25):  # near copies
        w = base.split()
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    for k in range(12):
        out.append(f"{text(30)} {passage} {text(10 + k)}")
        out.append(f"{text(25)}\n{line}\n{text(25)}")
    out += [text(60) for _ in range(10)] + [text(3000), "ab " * 300, passage + " " + passage]
    return out
