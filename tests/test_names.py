"""Names in texts by the word trie against a plain search."""

import random
import re

import numpy as np
import pytest

from quillstone.operators import names


def plain_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def plain_mentions(texts, aliases):
    out = set()
    for path, text in texts:
        w = f" {' '.join(plain_words(text))} "
        for i, alias in aliases:
            a = " ".join(plain_words(alias))
            if a and f" {a} " in w:
                out.add((path, i))
    return out


def found(spark, texts, aliases):
    rows = names.mentions(spark.createDataFrame(texts, "path string, content string").repartition(3), spark.createDataFrame(aliases, "id int, alias string")).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_mentions_are_those_of_a_plain_search(spark):
    rng = random.Random(1)
    vocab = ["a", "b", "ab", "ba", "ü", "漢字", "x1", "a", "a"]
    some = lambda n: rng.choice(" -_.\n").join(rng.choice(vocab) for _ in range(n))
    texts = [(f"t{i}", some(rng.randint(0, 25))) for i in range(120)] + [("null", None), ("blank", " .\n"), ("t0", "a b again")]
    aliases = [(i % 25, some(rng.randint(1, 6))) for i in range(60)] + [(90, ""), (91, "--"), (92, "absent name"), (93, "A"), (93, "a")]
    got = found(spark, texts, aliases)
    assert got == plain_mentions(texts, aliases) and len(got) > 100


def test_names_do_not_cross_texts_and_no_aliases(spark):
    texts = [("1", "one two"), ("2", "three four")]
    assert found(spark, texts, [(1, "two three"), (2, "three four"), (3, "four")]) == {("2", 2), ("2", 3)}
    assert found(spark, texts, [(1, " ")]) == set()


def test_many_aliases_are_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(names, "small", lambda df: df)
    aliases = [(i, f"name {i} of it") for i in range(3000)]
    texts = [(str(i), f"here is name {i} of it, and name {i + 1} of them") for i in range(0, 6000, 500)]
    assert found(spark, texts, aliases) == plain_mentions(texts, aliases)


@pytest.mark.parametrize("longest", [1, 2, 5])
def test_steps_of_a_long_text_lose_no_run(monkeypatch, longest):
    monkeypatch.setattr(names, "STEP", 40)
    rng = random.Random(longest)
    text = "".join("x" * rng.choice((1, 2, 3, 90)) + " " for _ in range(300)).encode()
    data, whole = np.frombuffer(text, np.uint8), set()
    for a, b in names.steps(data, longest):
        own = text[a:b].split()
        assert text[b - 1 : b] == b" "
        start = text[:a].count(b" ")
        whole |= {(start + i, n) for i in range(len(own)) for n in range(1, longest + 1) if i + n <= len(own)}
    total = len(text.split())
    assert whole >= {(i, n) for i in range(total) for n in range(1, longest + 1) if i + n <= total}


def test_words_of_odd_buffers():
    for text in (b"", b" ", b"a ", b"  a  bc ", b"x" * 5000 + b" y "):
        starts, ends, h = names.words(np.frombuffer(text, np.uint8))
        assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == text.split()
        assert len(set(h.tolist())) == len(set(text.split()))
