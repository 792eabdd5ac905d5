"""Conversation repair, personal data and vector codes against brute force, planted rows and hand rows."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from draper.llm import conversation_repair, personal_data, vector_codes

# ---- conversation repair

TALKS = "conv_id long, turn long, role string, text string, edits string, cost string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def faults(rows):
    """(role, text, fault) of the rows of one conversation in order."""
    seen, out = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not body.strip(" \t\n\v\f\r") else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by trying every string of edits with at most two insertions in a gap."""
    rows, best = faults(rows), None
    gaps = ["", "I", "II"]
    kinds = [["D"] if f in ("blank", "duplicate") else ["K", "R", "D"] for _, _, f in rows]
    for steps in itertools.product(*kinds):
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            audit = "".join(g + s for g, s in zip(inserts, [*steps, ""]))
            cost, out, at, ok = 0, [], 0, True
            system = False
            for e in audit:
                if e == "I":
                    cost += 2
                    out.append((None, ""))
                    continue
                role, text, fault = rows[at]
                at += 1
                cost += {"K": 0, "R": 2, "D": 3}[e] + (e != "D" and fault == "truncated")
                if e != "D":
                    system |= not out and e == "K" and role[:1] == "s"
                    out.append((role if e == "K" else None, text))
            for k, (role, text) in enumerate(out):
                want = "s" if system and k == 0 else "ua"[(k - system) % 2]
                ok &= role is None or role[:1] == want
                out[k] = (role or {"u": "user", "a": "assistant", "s": "?"}[want], text)
            ok &= (len(out) - system) % 2 == 0 and not (system and len(out) == 1)
            if ok and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
    return best


def talk(rng, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "unknown", None]
    texts = ["Hello.", "What?", "cut off", "", " \t", "yes!", None, "Hello.  ", "a.b"]
    turns = sorted(rng.choices([None, *range(n + 2)], k=n), key=lambda t: (t is not None, t or 0))
    return [(t, rng.choice(roles), rng.choice(texts)) for t in turns]


def ordered(rows):
    """As the operator orders: turn (null first), role, digest."""
    plain = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    return sorted(plain, key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), sha(sha(v[1]) + v[2])))


def test_repair_matches_every_string_of_edits(spark, monkeypatch):
    rng = random.Random(3)
    talks = {i: talk(rng, rng.randint(1, 4)) for i in range(60)}
    talks |= {None: [(0, "user", "Hi."), (1, "assistant", "Ho.")], -5: [(3, "system", "S.")]}
    df = spark.createDataFrame([(c, *r, "x", "y") for c, rows in talks.items() for r in rows], TALKS).repartition(3)
    got = {r["conv_id"]: r for r in conversation_repair.reports(conversation_repair.repair_conversations(df)).collect()}
    assert got.keys() == talks.keys()
    for c, rows in talks.items():
        rows = ordered(rows)
        named = faults([(r, x) for _, r, x in rows])
        kinds, initials = Counter(f for _, _, f in named), [r[:1] for r, _, _ in named]
        turns = [t for t, _, _ in rows if t is not None]
        cost, audit, repaired = cheapest([(r, x) for _, r, x in rows])
        assert (got[c]["cost"], got[c]["audit"], got[c]["repaired_sha256"]) == (cost, audit, sha(repaired)), rows
        assert got[c]["gaps"] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert [got[c][k] for k in ("blank", "duplicate", "truncated")] == [kinds[k] for k in ("blank", "duplicate", "truncated")]
        assert got[c]["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def automaton(rows):
    """The same by a row at a time over four states."""
    add = lambda x, c, e: None if x is None else (x[0] + c, x[1] + e)
    least = lambda *xs: min((x for x in xs if x is not None), default=None)
    e, s, u, a = (0, ""), None, None, None
    for role, _, fault in faults(rows):
        de, ds, du, da = (add(x, 3, "D") for x in (e, s, u, a))
        if fault not in ("blank", "duplicate"):
            cut, i = fault == "truncated", role[:1]
            pu, pa = (cut + (0 if i == "u" else 2), "K" if i == "u" else "R"), (cut + (0 if i == "a" else 2), "K" if i == "a" else "R")
            ds = least(ds, add(e, cut, "K")) if i == "s" else ds
            nu = least(du, *(add(x, *pu) for x in (e, s, a)), add(u, pu[0] + 2, "I" + pu[1]))
            da = least(da, add(u, *pa), *(add(x, pa[0] + 2, "I" + pa[1]) for x in (e, s, a)))
            du = nu
        e, s, u, a = de, ds, du, da
    return least(e, a, add(u, 2, "I"), add(s, 4, "II"))


def test_repair_of_long_conversations_in_pieces(spark, monkeypatch):
    """A conversation that holds most rows lies over partitions and pieces; its matrices give what one pass gives."""
    rng = random.Random(4)
    roles, texts = ["user", "assistant", "system", "tool"], ["Yes.", "cut", "", "No!"]
    hot = [(t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.3 else f"Line {t}" + rng.choice([".", "", "!"])) for t in range(5000)]
    rest = [(i, t, r, f"{i} {t}.") for i in range(2, 400) for t, r in enumerate(("user", "assistant"))]
    df = spark.createDataFrame([(1, *r) for r in hot] + rest, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = conversation_repair.repair_conversations(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert pieces.where("conv_id = 1").select("pid").distinct().count() > 1 and pieces.where("conv_id = 1").count() > 4
    got = {r["conv_id"]: r for r in conversation_repair.reports(pieces).collect()}
    rows = ordered(hot)
    cost, audit = automaton([(r, x) for _, r, x in rows])
    assert (got[1]["cost"], got[1]["audit"]) == (cost, audit) and got[1]["gaps"] == 0
    assert len(got) == 399 and all(got[i]["audit"] == "KK" and got[i]["cost"] == 0 for i in range(2, 400))
    said = [t for r in pieces.where("conv_id = 1").orderBy("pid", "seq").collect() for t in r["repaired"]]
    assert got[1]["repaired_sha256"] == sha("\n".join(f"{t['role']}:{t['text']}" for t in said))
    assert [t["role"][0] for t in said[said[0]["role"] == "system":]] == ["u", "a"] * ((len(said) - (said[0]["role"] == "system")) // 2)


def test_repair_repeated_rows_long_texts_and_empty(spark):
    long = "word " * 600_000 + "end."
    rows = [(1, 0, "user", long), (1, 1, "assistant", "Fine.")] + [(1, 2, "user", "Same.")] * 900 + [(2, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r["conv_id"]: r for r in conversation_repair.reports(conversation_repair.repair_conversations(df)).collect()}
    assert got[1]["duplicate"] == 899 and got[1]["audit"] == "KKK" + "D" * 899 + "I" and got[1]["cost"] == 2699
    assert got[1]["repaired_sha256"] == sha(f"user:{long}\nassistant:Fine.\nuser:Same.\nassistant:")
    assert got[2]["audit"] == "D" and got[2]["blank"] == 1 and got[2]["repaired_sha256"] == sha("")
    assert conversation_repair.reports(conversation_repair.repair_conversations(df.limit(0))).count() == 0


# ---- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def letters():
    rng = random.Random(9)
    bits = ["a@b.c", "x.y@host.example.com", "_q@z.org", "@", ".", "-", "+", "1", "22", "300", "10.0.0.1", "1.2.3.4.5.6.7.8", "999.1.1.1", "001.002.3.4",
            "4111111111111111", "4111 1111-1111 1111", "378282246310005", "4111111111111112", "+1 (487) 555-7209", "+49 30 12345678", "+123", " ", " ", "é", "😀", "\n", "word", "(", ")"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    return [None, "", "a@b.com_x@y.zz", "a.b.c@d.e@f.g", *texts]


#: Texts on which patterns that give back would take squares, and their spans.
LONG = [
    ("7" * 300_000 + "; 4111111111111111", [(300_002, 2, "card", 300_018)]), ("a" * 300_000 + "@", []), ("x@y" * 100_000, []), ("+1" + " " * 200_000 + "(" * 1000, []),
    ("1." * 100_001 + "1", [(8 * i, 1, "ip", 8 * i + 7) for i in range(25_000)]), ("😀" * 50_000 + "me@home.org", [(50_000, 0, "email", 50_011)]),
]


def test_base_spans_match_plain_patterns(spark, letters):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(letters)] + [(None, "null@id.org", None, None), (7, letters[7], "twice", None)]
    rows += [(1000 + i, t, None, None) for i, (t, _) in enumerate(LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, kind string").repartition(4)
    got = personal_data.find_personal_data(df, threshold=2.0).collect()
    assert len(got) == len(rows)
    for r in got:
        got_spans = [(s["start"], s["rank"] - 1, s["kind"], s["stop"]) for s in r["spans"]]
        if (r["doc_id"] or 0) >= 1000:
            assert got_spans == LONG[r["doc_id"] - 1000][1]
            continue
        text = "null@id.org" if r["doc_id"] is None else letters[r["doc_id"]] or ""
        assert got_spans == base_spans(text), text


def test_query_counts_and_digests_base_spans(spark, letters, tmp_path):
    spark.createDataFrame(list(enumerate(letters)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in personal_data.op12_personal_data(spark, str(tmp_path)).collect():
        base = base_spans(letters[r["doc_id"]] or "")
        said = [f"{kind}:{start}:{stop}" for start, _, kind, stop in base]
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(b[2] == k for b in base) for k in PLAIN]
        assert r["base_sha256"] == sha(",".join(said)) and set(said) <= set(r["spans"].split(","))


def test_classifier_adds_other_spellings_and_leaves_plain_text(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    rows = []
    for i in range(400):
        text = " ".join(word() for _ in range(30))
        if i % 4 == 0:
            text += f" mail {word()}.{i}@{word()}.com or phone +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} now"
        if i % 20 == 1:
            text += f" contact: {word()}{i} (at) {word()} (dot) com thanks"
        if i % 4 == 2:
            text += f" token: {word()}{rng.randint(10**8, 10**9)}x9 and version 12345678{i}z"
        rows.append((i, text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    added = {r["doc_id"]: [s for s in r["spans"] if not s["base"]] for r in personal_data.find_personal_data(df).collect()}
    assert all(len(added[i]) == 1 and "(at)" in rows[i][1][added[i][0]["start"] : added[i][0]["stop"]] for i in range(1, 400, 20))
    assert not any(added[i] for i in range(400) if i % 20 != 1)


def plain_em(patterns, rounds):
    """(share, rates) by plain loops over {votes: n}."""
    prior = [[[0.35, 0.5, 0.15], [0.15, 0.5, 0.35]] for _ in personal_data.LABELERS]
    share, rates = 0.5, prior
    for _ in range(rounds):
        post = {}
        for votes in patterns:
            yes, no = share, 1 - share
            for j, v in enumerate(votes):
                yes, no = yes * rates[j][1][v + 1], no * rates[j][0][v + 1]
            post[votes] = yes / (yes + no)
        total, yes = sum(patterns.values()), sum(n * post[v] for v, n in patterns.items())
        rates = [[[(sum(n * (post[v] if c else 1 - post[v]) for v, n in patterns.items() if v[j] == k - 1) + prior[j][c][k]) / ((yes if c else total - yes) + 1)
                   for k in range(3)] for c in range(2)] for j in range(len(personal_data.LABELERS))]
        share = (yes + 1) / (total + 2)
    return share, rates


def test_em_and_regression_match_plain_loops(spark):
    rng = random.Random(6)
    patterns = Counter(tuple(rng.choice((-1, 0, 1)) for _ in personal_data.LABELERS) for _ in range(300))
    df = spark.createDataFrame([("ip", list(v), n) for v, n in patterns.items()], "kind string, votes array<int>, n long")
    got = personal_data.reliabilities(df, rounds=8).collect()[0]
    share, rates = plain_em(patterns, 8)
    assert got["share"] == pytest.approx(share) and np.allclose(got["rates"], rates)
    x = [[float(rng.random() < 0.5) for _ in personal_data.FEATURES] for _ in range(40)]
    rows = [("ip", v, rng.randint(1, 9), rng.random()) for v in x]
    got = personal_data.classifier(spark.createDataFrame(rows, "kind string, x array<double>, n long, p double"), rounds=25).collect()[0]["weights"]
    w, total, wide = np.zeros(len(x[0]) + 1), sum(r[2] for r in rows), len(x[0]) + 1
    m = np.array([[1.0, *r[1]] for r in rows])
    for _ in range(25):
        slope = np.array([r[2] for r in rows]) * (np.array([r[3] for r in rows]) - 1 / (1 + np.exp(-m @ w)))
        w = w + 4 / (wide * total + 4) * (m.T @ slope - w)
    assert np.allclose(got, w)


def test_personal_data_redacts_and_takes_empty_tables(spark):
    df = spark.createDataFrame([(1, "é write a@b.com or +1 (487) 555-7209 now"), (2, None)], "doc_id long, text string")
    found = personal_data.find_personal_data(df)
    out = {r["doc_id"]: r["t"] for r in df.join(found, "doc_id").select("doc_id", personal_data.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert out == {1: "é write [email] or [phone] now", 2: None}
    assert personal_data.find_personal_data(df.limit(0)).count() == 0


# ---- vector codes


def by_hand(vectors, parts, entries, rounds):
    """Codes, errors and codebooks by comparing everything with everything."""
    x = np.array(vectors, np.int64)
    pieces = np.split(x, parts, axis=1)
    books = [p[:entries].copy() for p in pieces]
    for n in range(rounds + 1):
        d = [((p[:, None] - b[None]) ** 2).sum(2) for p, b in zip(pieces, books)]
        which = [v.argmin(1) for v in d]
        if n < rounds:
            for p, b, w in zip(pieces, books, which):
                for e in set(w.tolist()):
                    own = p[w == e]
                    b[e] = [int(s) // len(own) for s in own.sum(0)]
    return np.stack(which, 1).tolist(), sum(v.min(1) for v in d).tolist(), books


def test_tree_finds_the_nearest_entry_with_ties():
    rng = np.random.default_rng(1)
    for k, spread in ((1, 3), (2, 2), (16, 2), (16, 1000), (40, 1 << 27)):
        entries = rng.integers(-spread, spread + 1, (k, 5))
        x = rng.integers(-spread, spread + 1, (3000, 5))
        x[:200] = entries[rng.integers(0, k, 200)]
        tree = vector_codes.VantageTree(entries)
        which, best = tree.nearest(x)
        d = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (which == d.argmin(1)).all() and (best == d.min(1)).all()
    # rows close to separate entries leave most of the tree unvisited
    entries = rng.integers(-(10**5), 10**5, (64, 4))
    tree = vector_codes.VantageTree(entries)
    tree.nearest(entries[rng.integers(0, 64, 2000)] + rng.integers(-5, 6, (2000, 4)))
    assert tree.compared < 2000 * 64 / 3


def test_codes_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 16).astype(np.float32).tolist(), int(i % 3) if i % 7 else None, "clash") for i in range(400)]
    rows += [(i + 1000, rows[3][1], 9, "hot") for i in range(200)] + [(3, rows[3][1], 1, None), (None, rows[5][1], 1, None)]
    bad = [(-1, None, 1, ""), (-2, [None] * 16, 1, ""), (-3, [float("nan")] * 16, 1, ""), (-4, [float("inf")] + [0.0] * 15, 1, ""), (-5, [1e30] * 16, 1, ""), (500, [0.5] * 8, 1, ""), (501, [0.5] * 9, 1, ""), (502, [], 1, "")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int, code string").repartition(5)
    kept = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[int(np.floor(4096.0 * c)) for c in r[1]] for r in kept]
    which, error, books = by_hand(ints, 8, 16, 6)
    codes, got_books = vector_codes.compress_vectors(df)
    assert all((a == b).all() for a, b in zip(books, got_books))
    by_label = Counter()
    for r, e in zip(kept, error):
        by_label[r[2]] += e
    want = sorted(((r[0], c, e, by_label[r[2]]) for r, c, e in zip(kept, which, error)), key=repr)
    got = vector_codes.label_errors(codes, heavy=4).collect()
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=repr) == want
    near = vector_codes.decoded(codes, got_books).where("vec_id = 3").first()["vector"]
    assert np.abs(np.array(near) - np.array(rows[3][1])).max() < 0.5


def test_codes_of_few_or_no_vectors(spark):
    df = spark.createDataFrame([(2, [1.0] * 8, 1), (1, [-1.0] * 8, None)], "vec_id long, embedding array<double>, label int")
    codes, books = vector_codes.compress_vectors(df)
    assert [b.tolist() for b in books] == [[[-4096], [4096]]] * 8
    assert {r["vec_id"]: (r["code"], r["error"]) for r in codes.collect()} == {1: ([0] * 8, 0), 2: ([1] * 8, 0)}
    codes, books = vector_codes.compress_vectors(df.limit(0))
    assert vector_codes.label_errors(codes).count() == 0 and books == []
