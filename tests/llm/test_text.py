"""Packing, decontamination, chat, licenses and personal data against brute force and round trips."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from quillstone.llm import chat, decontaminate, licenses, packing, pii
from quillstone.llm.queries import ORACLES, QUERIES

from .conftest import LONG, rows


@pytest.mark.parametrize("which", ["odd", "clashing", "sample"])
@pytest.mark.parametrize("targets", [None, {"a": 3, "b": 1}])
def test_packing(request, which, targets):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    tokenizer.encode_special_tokens = True
    pieces = packing.pack(docs, targets=targets).collect()
    # Each row's pieces: whole, gapless and with the tokenizer's ids. Rows with one id are told apart by their sums.
    want = sorted((str(r["doc_id"]), len(e.ids) + 1) for r, e in ((r, tokenizer.encode(r["text"] or "", add_special_tokens=False)) for r in docs.collect()))
    total = sum(n for _, n in want)
    assert sum(p["length"] for p in pieces) == total and all(p["length"] > 0 for p in pieces)
    assert sorted((str(p["doc_id"]), p["doc_tokens"]) for p in pieces if p["start"] == 0) == want
    single = {i: t for i, t in ((r["doc_id"], r["text"]) for r in docs.collect()) if i is not None and i != 3}
    for i, text in single.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"]):
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for w, own in by.items():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at == min(4096, total - 4096 * w)


def test_mixture_in_every_window():
    """Up to every window's end each queue is three runs off its share at most: what one window lacks, the next has more."""
    totals = {"a": 400_000, "b": 90_000, "c": 10_000}
    s = packing.Schedule({q: n // packing.RUN for q, n in totals.items()})
    per, whole, got = packing.LENGTH // packing.RUN, sum(n // packing.RUN for n in totals.values()), {}
    for q, n in totals.items():
        for w, _, k in s.pieces(q, 0, n // packing.RUN):
            got[w, q] = got.get((w, q), 0) + k
    for w in range(whole // per):
        for q, n in totals.items():
            assert abs(got.get((w, q), 0) - per * (n // packing.RUN) / whole) < 4
            assert abs(sum(got.get((x, q), 0) for x in range(w + 1)) - (w + 1) * per * (n // packing.RUN) / whole) < 3


def test_many_sources_do_not_shred_documents(spark):
    docs = [(i, "word " * 2000, f"s{i % 400}") for i in range(400)]
    pieces = packing.pack(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert len(pieces) <= 400 * (2001 // packing.RUN + 2)
    spans = sorted((4096 * p["sequence_id"] + p["offset"], p["length"]) for p in pieces)
    assert spans[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(spans, spans[1:], strict=False)) and sum(n for _, n in spans) == 400 * 2001


def test_targets_among_many_sources(spark):
    docs = [(i, "one two three", f"s{i}") for i in range(4200)] + [(10_000 + i, "word " * 1500, "ab"[i % 2]) for i in range(16)]
    pieces = packing.pack(spark.createDataFrame(docs, "doc_id long, text string, source string"), targets={"a": 3, "b": 1}).collect()
    by = {}
    for p in pieces:
        own = "other" if p["doc_id"] < 10_000 else "ab"[p["doc_id"] % 2]
        by[p["sequence_id"], own] = by.get((p["sequence_id"], own), 0) + p["length"]
    for w in range(3):
        assert (by[w, "a"], by[w, "b"]) == (3072, 1024) and (w, "other") not in by
    spans = sorted((4096 * p["sequence_id"] + p["offset"], p["length"]) for p in pieces)
    assert all(x + n == y for (x, n), (y, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    assert {p["doc_id"] for p in pieces} == {d[0] for d in docs}


def test_dealing_is_fair_and_never_falls():
    rng = np.random.default_rng(6)
    for whole in (1, 2, 7, 100, 1000):
        cuts = sorted({0, whole, *rng.integers(0, whole + 1, 6).tolist()})
        last = [0] * len(cuts)
        for runs in range(0, 3 * whole + 2):
            now = [packing.dealt(x, runs, whole) for x in cuts]
            assert now[-1] == runs and all(b - a >= d - c for a, b, c, d in zip(now, now[1:], last, last[1:]))
            assert all(abs(n - runs * x / whole) < 3 for n, x in zip(now, cuts, strict=True))
            last = now


@pytest.mark.parametrize("weights", [None, {"a": 1}, {"a": 1, "b": 7, None: 2}])
def test_schedules_place_every_run_once(weights):
    totals = {"a": 5, "b": 10_000, None: 3, "d": 0}
    s = packing.Schedule(totals, weights)
    seen = set()
    for q, n in totals.items():
        for w, off, k in s.pieces(q, 0, n, 32):
            new = {(w, off + i) for i in range(k)}
            assert not new & seen
            seen |= new
    assert sorted(seen) == [(i // 32, i % 32) for i in range(10_008)]


def test_schedules_of_many_targets_are_quick():
    import time

    at = time.time()
    s = packing.Schedule({f"s{i}": 100 + i * 37 % 1000 for i in range(400)}, {f"s{i}": 1 + i % 9 for i in range(400)})
    assert s.size == sum(100 + i * 37 % 1000 for i in range(400)) and time.time() - at < 5


def test_words_of_hard_texts():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    tokenizer.encode_special_tokens = True
    texts = ["Don't stop... it's 3.14, O'Neil's!", "a\x01b \x01 c", "<|endoftext|> x", "é ́a A.B;C", "漢字。カナ", "İSTANBUL ΣΑΣ", "a b c", "x" * 3000, "'s 'S", "1234 5.6", "A.'s"]
    import pyarrow as pa

    from quillstone.llm.common import buffer_of

    ids, at = packing.Words(packing.tokenizer_path()).ids(*buffer_of(pa.array([t.encode() for t in texts], pa.binary())), 2)
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2], t


def edit_distance_within(window, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words, n))
    items = [(k, text(40)) for k in range(12)] + [(20, None), (21, ""), (22, "short"), (None, text(30))]
    docs, truth = [], {}
    for i in range(120):
        body = text(150)
        if i % 3 == 0:
            k = i % 12
            leak = list(items[k][1])
            for _ in range(i % 7):  # edits spread over the passage: under the budget of every window
                leak[rng.integers(len(leak))] = "z"
            body = body[:300] + " " + "".join(leak).upper().replace(" ", "  ") + "\n" + body[300:]
            truth[i] = k
        docs.append((i, body))
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {i: k for i, v in got.items() for k in v} == truth


def test_verification_is_the_edit_distance():
    rng = np.random.default_rng(0)
    for _ in range(60):
        window = bytes(rng.choice(list(b"abcd"), 24))
        region = bytes(rng.choice(list(b"abcd"), 10)) + bytes(b if rng.random() > 0.1 else 97 for b in window) + bytes(rng.choice(list(b"abcd"), 10))
        for e in (0, 1, 2, 4):
            assert decontaminate.within(window, region, e) == (edit_distance_within(window, region) <= e)


def test_decontamination_of_windows_at_every_offset():
    rng = np.random.default_rng(5)
    chars = lambda n: rng.choice(list(b"abcdefghijklmnopq"), n).astype(np.uint8).tobytes()
    item = chars(330)
    index = decontaminate.Index([(7, item)])
    cut = lambda texts: index.search(*decontaminate.normalised(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])))
    for size in (96, 97, 110, 120, 137, 142):
        texts = [chars(at % 7 * 50) + item[at : at + size] + chars(60) for at in range(len(item) - size + 1)]
        assert sorted(d for d, _ in cut(texts)) == list(range(len(texts))), size
    # Five edits are found at every offset; in 96 bytes with more, or in 80 bytes, nothing is.
    edited, broken, short = [], [], []
    for at in range(len(item) - 95):
        own = bytearray(item[at : at + 96])
        for i in (10, 30, 50):
            own[i] = ord("z")
        own[70:70] = b"z"
        del own[85]
        edited.append(chars(40) + bytes(own) + chars(40))
        for i in range(0, len(own), 12):
            own[i] = ord("z")
        broken.append(chars(40) + bytes(own) + chars(40))
        short.append(chars(40) + b"z" + item[at : at + 80] + b"z" + chars(40))
    assert sorted(d for d, _ in cut(edited)) == list(range(len(edited)))
    assert cut(broken) == [] and cut(short) == []


def test_decontamination_is_every_window_everywhere():
    """The search against aligning each window of each item with all of each text."""
    rng = np.random.default_rng(8)
    chars = lambda n: rng.choice(list(b"abcde fgh"), n).astype(np.uint8).tobytes()
    items = [(k, chars(n)) for k, n in enumerate((60, 96, 97, 130, 200, 30))]
    index = decontaminate.Index(items)
    texts = []
    for _ in range(150):
        item = items[rng.integers(len(items))][1]
        a = rng.integers(0, max(1, len(item) - 60))
        own = bytearray(item[a : a + rng.integers(25, 140)])
        for _ in range(rng.integers(0, 9)):
            p = rng.integers(len(own))
            own[p : p + rng.integers(0, 2)] = chars(rng.integers(0, 2))
        texts.append(chars(rng.integers(0, 60)) + bytes(own) + chars(rng.integers(0, 60)))
    buf, off = decontaminate.normalised(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    want = []
    for d in range(len(texts)):
        own = buf[off[d] : off[d + 1]].astype(np.int16)
        for w, body in enumerate(index.bodies):
            size = int(index.size[w])
            windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(body, np.uint8).astype(np.int16), size)
            if decontaminate.any_within(windows, np.broadcast_to(own, (len(windows), len(own))), int(index.edits[w])):
                want.append((d, w))
    assert sorted(index.search(buf, off)) == want and 30 < len(want) < 150


def test_decontamination_by_short_items(spark):
    items = [(1, "Yes"), (2, "the end"), (3, "a b c"), (4, "forty-two it is"), (5, "  "), (6, "nine bytes"), (7, "yes"), (8, "?!")]
    docs = [(1, "Oh  YES\nindeed"), (2, "yesterday"), (3, "this is the\tend"), (4, "the endless"), (5, "x a b c d"), (6, "so forty-two it is."), (7, "so forty-two,it is"), (8, "forty-two it is"), (9, "xnine bytes"), (10, "nine bytes"), (11, None), (12, "what?! (yes)")]
    got = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: r["item_ids"] for r in got.collect()} == {1: [1, 7], 2: [], 3: [2], 4: [], 5: [3], 6: [4], 7: [4], 8: [4], 9: [], 10: [6], 11: [], 12: [1, 7]}


def test_decontamination_reports_negative_ids(spark):
    items = [(-1, LONG[:200]), (-(2**40), LONG[:120]), (None, LONG[:150]), (3, "something else " * 12)]
    docs = spark.createDataFrame([(1, LONG[:400]), (2, "clean")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.find(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got[1]["item_ids"] == [-(2**40), -1] and got[1]["n_items"] == 2 and got[1]["contaminated"]
    assert got[2]["item_ids"] == [] and not got[2]["contaminated"]


def test_decontamination_odd_rows(spark, odd, clashing, none, sample):
    items = spark.createDataFrame([(1, LONG[:300]), (2, None)], "item_id long, text string")
    for docs in (odd, clashing):
        assert {r["doc_id"] for r in decontaminate.find(docs, items).collect() if r["contaminated"]} == {9}
        kept = decontaminate.clean(docs, items)
        assert kept.columns == docs.columns and kept.count() == 13
    assert decontaminate.find(none, items).collect() == [] and decontaminate.clean(none, items).collect() == []
    assert decontaminate.clean(odd, items.where("false")).count() == 14
    # Many blocks give what one does.
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole, size = rows(decontaminate.find(sample, bench)), decontaminate.BLOCK_BYTES
    try:
        decontaminate.BLOCK_BYTES = 3000
        assert rows(decontaminate.find(sample, bench)) == whole
    finally:
        decontaminate.BLOCK_BYTES = size


def brute_segments(turns, pairs):
    out = []
    order = lambda t: (t is not None, t)
    for pair, chosen, rejected in pairs:
        slots = []
        for conv in (chosen, rejected):
            own = {}
            for c, turn, role, text in turns:
                if c is not None and c == conv:
                    own.setdefault(turn, []).append((role or "user", text or ""))
            slots.append({t: sorted(v) for t, v in own.items()})
        a, b = slots
        shared = set()
        for t in sorted(set(a) | set(b), key=order):
            if a.get(t) != b.get(t):
                break
            shared.add(t)
        for part, side in (("chosen", a), ("rejected", b)):
            for t, v in side.items():
                for role, text in v:
                    if t not in shared:
                        out.append((pair, part, t, role, f"<|{role}|>\n{text}\n", int(role == "assistant")))
                    elif part == "chosen":
                        out.append((pair, "prompt", t, role, f"<|{role}|>\n{text}\n", 0))
    return sorted(map(str, out))


def test_chat(spark):
    turns = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "a"), (0, 2, "user", "more"),
        (1, 0, "user", "hi"), (1, 1, "assistant", "b"), (1, 2, "user", "more"),
        (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, "user", "same"), (3, 1, "assistant", "same"),
        (4, 0, "user", "alone"), (6, 0, None, None), (7, 0, "user", ""), (7, 1, "assistant", "x"),
        (8, None, "user", "null turn"), (9, None, "user", "null turn"), (9, 0, "assistant", "y"),
        (10, 0, "user", "twice"), (10, 0, "user", "twice"), (11, 0, "user", "twice"), (None, 0, "user", "lost"),
        (12, 0, "user", "p"), (12, 0, "user", "q"), (13, 0, "user", "q"), (13, 0, "user", "p"),
    ]
    table = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, pair_id string")
    pairs = [(k, 2 * k, 2 * k + 1) for k in range(7)]
    got = chat.segments(table, chat.neighbours(table))
    assert sorted(str(tuple(r)[:6]) for r in got.collect()) == brute_segments(turns, [p for p in pairs if p[0] != 5 or True])
    text = {r["pair_id"]: r for r in chat.assemble(got).collect()}
    assert text[0]["prompt"] == "<|user|>\nhi\n" and text[0]["chosen"] == "<|assistant|>\na\n<|user|>\nmore\n" and text[1]["rejected"] == ""
    assert chat.segments(table.where("false"), chat.neighbours(table.where("false"))).collect() == []


def test_chat_oracle(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    want, got = con.sql(ORACLES["op8_chat"]).df(), QUERIES["op8_chat"](spark, d).toPandas()
    cols = list(want.columns)
    assert sorted(map(str, want.values.tolist())) == sorted(map(str, got[cols].values.tolist()))


def test_licenses(spark, odd, clashing, none):
    mit = licenses.TEMPLATES["MIT-grant"]
    table = [
        (1, "intro " * 50 + "Released under the MIT License. the the the MIT"),
        (2, "Licensed under the Apache License, Version 2.0.\ntext\nLicensed under the Apache License, Version 2.0."),
        (3, "permission is\n * hereby granted, free of cost, to any person obtaining a copy of this software and its documentation files (the software), to deal in the Software without restriction"),
        (4, "a license of some kind under the sun"),
        (5, "the " * 5000 + mit + " the" * 5000),
        (6, "This work is licensed under the GNU General Public License, version 3."),
        (7, "Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0."),
    ]
    got = {r["doc_id"]: r for r in licenses.find(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert {i: r["licenses"] for i, r in got.items()} == {1: "MIT", 2: "Apache-2.0", 3: "MIT-grant", 4: "", 5: "MIT-grant", 6: "GPL-3.0", 7: "CC-BY-4.0,CC-BY-NC-4.0"}
    assert got[2]["n_notices"] == 2 and got[1]["spans"] == "MIT:50:55" and got[5]["coverage"] == 1.0 and 0.8 <= got[3]["coverage"] < 1
    for docs in (odd, clashing):
        assert {r["licenses"] for r in licenses.find(docs).collect()} == {""}
    assert licenses.find(none).collect() == []


def test_patience():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = ([bytes([c]) for c in rng.choice(list(b"abcdefgh"), rng.integers(0, 14))] for _ in "ab")
        got = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p < r and q < s for (p, q), (r, s) in zip(got, got[1:]))
    for _ in range(200):
        x = list(rng.integers(0, 12, 10))
        best = [1] * 10
        for i in range(10):
            best[i] = 1 + max((best[j] for j in range(i) if x[j] < x[i]), default=0)
        got = licenses.longest_increasing(x)
        assert len(got) == max(best) and all(x[i] < x[j] for i, j in zip(got, got[1:]))


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    fits = {
        "email": lambda s: True,
        "ip": lambda s: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)),
        "phone": lambda s: 8 <= len(digits(s)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if fits[k](m[0])]


def test_pii_base_spans_are_the_patterns():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    piece = st.sampled_from(["a@b.c", "x.y+z@mail-1.example.com", "@", "a@b", ".", "..", "1.2.3.4", "255.0.0.256", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (202) 555-0143", "+", "-", " ", "é", "12", "0", "0001.2.3.4", "@a.b", "a@b.c@d.e", "\n", "+1+1234567890", "999"])

    @settings(max_examples=600, deadline=None)
    @given(st.lists(piece, max_size=12).map("".join))
    def same(text):
        assert pii.base_spans(text) == plain_spans(text)

    same()


@pytest.mark.parametrize("which", ["odd", "clashing", "sample"])
def test_pii_rows(request, which):
    docs = request.getfixturevalue(which)
    got = sorted(str((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"])) for r in pii.find(docs).collect())
    want = []
    for r in docs.collect():
        s = plain_spans(r["text"] or "")
        want.append(str((r["doc_id"], *(sum(x[0] == k for x in s) for k in PATTERNS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest())))
    assert got == sorted(want)


def test_pii_added_kinds_and_redaction(spark):
    assert [s[0] for s in pii.all_spans("IBAN DE89 3704 0044 0532 0130 00 PLEASE")] == ["iban"]
    assert not pii.all_spans("IBAN DE88 3704 0044 0532 0130 00")
    assert [s[0] for s in pii.all_spans("my ssn is 123-45-6789")] == ["national_id"] and not pii.all_spans("part 123-45-6789")
    assert [s[0] for s in pii.all_spans("amex card 378282246310005")] == ["short_card"] and not pii.all_spans("378282246310005")
    assert pii.redacted("to a@b.co or +1 202 555 0143, paid by (4111 1111 1111 1111) at 10.0.0.1") == "to [EMAIL] or [PHONE], paid by ([CARD]) at [IP]"
    docs = spark.createDataFrame([(1, None, "k"), (2, "x a@b.co", "k")], "doc_id long, text string, spans string")
    assert sorted(map(tuple, pii.redact(docs).collect())) == [(1, None, "k"), (2, "x [EMAIL]", "k")]


def test_pii_scores_and_secrets(spark):
    texts = ["write to a@b.co", "a@b.co", "order a@b.co", "call +1 202 555 0143", 'token = "6df57b16f87eabefefcab67b433efd90636bb6bd"', "6df57b16f87eabefefcab67b433efd90636bb6bd", "secret " + "a" * 40]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["scores"] for i in range(7)] == ["0.9", "0.6", "0.3", "0.6", "0.6", "", ""]
    assert [got[i]["n_spans"] for i in range(7)] == [1, 1, 1, 1, 1, 0, 0] and got[4]["spans"] == "secret:9:49"


def test_pii_long_runs_are_linear():
    import time

    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + " (" * 150_000, "a." * 150_000 + "@", "A1" * 150_000, "DE12" + " A" * 150_000, "@" * 300_000, "a" * 120_000 + " " + "a" * 33_000 + "@x.y", "a" * 150_000 + "@" + "b" * 150_000, "a-" * 75_000 + "@" + "b-" * 75_000 + "@c", "a1" * 150_000):
        at = time.time()
        pii.all_spans(text)
        assert time.time() - at < 5, text[:10]
