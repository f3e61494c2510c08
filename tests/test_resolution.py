"""Entity resolution: planted variants against all pairs, copies, hot names, odd rows; a vault's pages."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillstone.operators.resolution import BLOCK, _agreement, blocks, components, fit, records, resolve

FIELDS = ("town", "mail")
ROWS = "id long, name string, town string, mail string, tokens string, entity int"


def planted(n=150, seed=4):
    """Rows, and pairs of ids that are one person: renamed, misspelt, turned round, or with a field gone."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdefghijklmnoprstuvwxyz") for _ in range(k))
    first = [word(5) for _ in range(12)]
    rows, pairs = [], set()
    for i in range(n):
        a, b, town, mail = rng.choice(first), word(7), f"t{rng.randrange(8)}", f"{word(6)}@x"
        rows.append((i, f"{a} {b}", town, mail))
        if i % 3 == 0:
            name = [f"{b.upper()}, {a}", f"{a} {word(1)}. {b}", f"{a} {b[:3]}q{b[4:]}"][i // 3 % 3]
            rows.append((1000 + i, name, town, None if i % 2 else mail))
            pairs.add((i, 1000 + i))
    return [(*r, "x", 1) for r in rows], pairs


def linked(out):
    members = {}
    for r in out.collect():
        members.setdefault(r["entity"], []).append(r["id"])
        assert r["entity"] <= r["id"]
    return {(a, b) for m in members.values() for a in m for b in m if a < b}


def test_planted_variants_are_found_as_by_all_pairs(spark):
    rows, want = planted()
    df = spark.createDataFrame(rows, ROWS)
    found = linked(resolve(df, "id", "name", FIELDS))
    assert len(found & want) >= 0.9 * len(want) and len(found - want) <= 0.02 * len(found)
    met = {tuple(r) for r in blocks(records(df, "id", "name", FIELDS), 2).collect()}
    assert len(met & want) >= 0.95 * len(want) and len(met) < len(rows) ** 2 / 4


def test_frequent_words_are_divided_by_what_else_their_records_have(spark):
    rows = [(i, "john smith", f"t{i // 4}", None, "x", 1) for i in range(4 * BLOCK)] + [(9000 + i, "john smith", "t1", f"m{i}", "x", 1) for i in range(2)]
    met = {tuple(r) for r in blocks(records(spark.createDataFrame(rows, ROWS), "id", "name", FIELDS), 2).collect()}
    same = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2]}
    assert met == same


def test_copies_nulls_and_empty_tables(spark):
    rows, _ = planted(90)
    odd = [(5000, "cora lind", "t1", "c@x", "x", 1), (5001, "cora lind", "t1", "c@x", "y", 2), (5002, "Lind Cora", "t1", "c@x", "y", 2), (5003, None, None, None, "y", 2), (5004, "", " ", None, "y", 2), (None, "cora lind", "t1", "c@x", "x", 1)]
    df = spark.createDataFrame(rows + odd, ROWS)
    got = {r["id"]: (r["entity"], r["n"]) for r in resolve(df, "id", "name", FIELDS).collect()}
    assert got[5000] == got[5001] == got[5002] == (5000, 3) and got[5003] == (5003, 1) and got[5004] == (5004, 1)
    assert len(got) == len(rows) + 5
    assert resolve(df.where("false"), "id", "name", FIELDS).count() == 0
    assert [tuple(r) for r in resolve(df.where("id = 0"), "id", "name").collect()] == [(0, 0, 1)]


def test_components(spark):
    rng = random.Random(2)
    chain = list(range(100, 160))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(7, i) for i in range(8, 40)] + [(1, 2), (2, 1), (3, 3)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(chain, 100), **dict.fromkeys(range(7, 40), 7), 1: 1, 2: 1, 3: 3}


def test_pairs_that_a_block_made_alike_are_no_matches():
    # Levels of name, town, mail: a block of towns and one of half the name's words make many pairs alike, few of which are matches.
    seen = {(2, 1, 1): 1000, (2, 1, -1): 1000, (3, 1, -1): 500, (3, 1, 1): 500, (1, 0, -1): 3466, (1, 0, 0): 990, (1, 1, -1): 154, (1, 1, 0): 55, (0, 1, -1): 24739, (0, 1, 0): 57433}
    p = fit(np.array(list(seen)), np.array(list(seen.values()), float), np.array([0.04, 1e-5]))
    assert [q >= 0.9 for q in p] == [True] * 4 + [False] * 6


def test_misspelt_names_meet_where_many_share_all_else(spark):
    word = lambda i: random.Random(i).randbytes(4).hex()
    rows = [(i, f"anna {word(i)}", "t1", None, "x", 1) for i in range(3 * BLOCK)] + [(9000, f"anna {word(0)[:4]}z{word(0)[4:]}", "t1", None, "x", 1)]
    met = {tuple(r) for r in blocks(records(spark.createDataFrame(rows, ROWS), "id", "name", FIELDS), 2).collect()}
    assert (0, 9000) in met and len(met) < 100


def test_a_misspelt_word_that_changes_places_is_near(spark):
    # Words are kept in order: "c11d2c92 c11d5" against "c11d5 c11dz2c92" are far apart as a whole.
    rows = [(0, "c11d5 c11d2c92", "t1", "m@x", "x", 1), (1, "c11d5 c11dz2c92", "t1", "m@x", "x", 1), (2, "c11d5 c11dz2d93", "t1", "m@x", "x", 1)]
    recs = records(spark.createDataFrame(rows, ROWS), "id", "name", FIELDS)
    x, y = (recs.select(F.struct(*recs.columns).alias(k)) for k in ("x", "y"))
    got = {(r["a"], r["b"]): r["g0"] for r in x.join(y, F.col("x.id") < F.col("y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), *_agreement(2)).collect()}
    assert got[0, 1] == 2 and got[0, 2] < 2


def test_who_lacks_a_field_goes_with_the_closer_of_two_that_differ_in_it(spark):
    rows, want = planted(300)
    # 5002 is 5000 misspelt, and two edits from 5001, who is someone else by mail; 5012 is 5010 turned round, an edit from 5011.
    odd = [(5000, "quirin abcdefgh", "t1", "a@x"), (5001, "quirin abcdefgk", "t1", "b@x"), (5002, "quirin abcdzefgh", "t1", None), (5010, "quirin tuvwxyab", "t2", "c@x"), (5011, "quirin tuvwxyac", "t2", "d@x"), (5012, "Tuvwxyab, Quirin", "t2", None)]
    got = {r["id"]: r["entity"] for r in resolve(spark.createDataFrame(rows + [(*r, "x", 1) for r in odd], ROWS), "id", "name", FIELDS).collect()}
    assert [got[i] for i in (5000, 5001, 5002, 5010, 5011, 5012)] == [5000, 5001, 5000, 5010, 5011, 5010]


def test_chance_pairs_of_a_large_block_are_no_matches():
    # 90,000 people and 18,000 again, met by first name and nation: pairs that share a first name, an initial and the nation are many by then.
    seen = {(3, 1, 1): 3000, (2, 1, 1): 6000, (3, 1, -1): 3000, (2, 1, -1): 6000, (1, 1, -1): 1500, (1, 1, 0): 1500, (0, 1, 0): 1_200_000, (0, 1, -1): 200_000}
    total = 108_000 * 107_999 / 2
    levels = np.array([0, 90 / 2e6 * total, 12_000, 6_000])
    levels[0] = total - levels.sum()
    p = fit(np.array(list(seen)), np.array(list(seen.values()), float), np.array([0.04, 1e-5]), levels, total)
    assert [q >= 0.9 for q in p] == [True] * 4 + [False] * 4


def test_fit_gets_the_shares_that_pairs_were_drawn_by():
    rng = np.random.default_rng(1)
    n, share = 40_000, 0.2
    match = rng.random(n) < share
    pick = lambda yes, no: np.where(match, rng.choice(len(yes), n, p=yes), rng.choice(len(no), n, p=no))
    drawn = np.stack([pick([0.05, 0.1, 0.25, 0.6], [0.6, 0.3, 0.08, 0.02]), pick([0.1, 0.9], [0.9, 0.1]), pick([0.2, 0.8], [0.95, 0.05])], 1)
    patterns, which, counts = np.unique(drawn, axis=0, return_inverse=True, return_counts=True)
    p = fit(patterns, counts.astype(float), np.array([0.1, 0.05]))
    assert abs((p @ counts) / n - share) < 0.02
    for q in (0.5, 0.9):  # as many matches as promised
        sure = p[which.ravel()] >= q
        assert abs(match[sure].mean() - p[which.ravel()][sure].mean()) < 0.02


def test_pages_of_one_person_are_merged_and_what_named_them_follows(spark, tmp_path):
    from quillstone.vault import Vault

    rng = random.Random(9)
    word = lambda k: "".join(rng.choice("abcdefghijklmnoprstuvwxyz") for _ in range(k))
    people, orgs, want = tmp_path / "md" / "wiki" / "people", tmp_path / "md" / "wiki" / "orgs", set()
    people.mkdir(parents=True)
    for channel in ("journal", "meetings", "emails", "chats", "clippings", "docs"):
        (tmp_path / "md" / "raw" / "inbox" / channel).mkdir(parents=True)
    orgs.mkdir()
    page = lambda slug, org, body="": (people / f"{slug}.md").write_text(f"---\ntype: person\nworks_at: [{org}]\n---\n{body}\n")
    for i in range(60):
        a, b, org = word(5), word(6), f"org{i % 12}"
        page(f"{a}-{b}", org)
        if i % 3 == 0:
            also = f"{b}-{a}" if i % 2 else f"{a}-{b}-jr"
            page(also, org)
            want.add(frozenset((f"{a}-{b}", also)))
    for i in range(12):
        (orgs / f"org{i}.md").write_text("---\ntype: org\n---\n")
    gone = max(min(want, key=sorted))
    kept = min(min(want, key=sorted))
    page("zz-teller", "org1", f"Met [[{gone}|a friend]].")
    v = Vault(spark, f"file://{tmp_path}/vault")
    v.init()
    v.load(str(tmp_path / "md"))
    v.project()
    same, found = v.same(), {}
    for r in same.collect():
        found.setdefault(r["identity_key"], set()).add(r["slug"])
    assert {frozenset(s) for s in found.values()} == want
    assert v.merge(identities=same).count() == len(want)
    assert v.table("pages").where(f"slug = '{gone}'").count() == 0 and v.table("edges").where(f"src = '{gone}' or dst = '{gone}'").count() == 0
    assert v.table("edges").where(f"src = '{kept}' and edge = 'works_at'").count() == 1
    assert f"[[{kept}|a friend]]" in v.table("pages").where("slug = 'zz-teller'").first()["body"]
