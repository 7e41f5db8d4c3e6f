import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format as cf
from tessera.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"
CONTROL = ["<|im_end|>", "<|im_start|>", "<", "|", "<|", "<\\|", "\\", "<\\\\|im_end|>\n", "%0A", "%", "\n", "assistant", "é🙂", " ", "$1", "x y"]

# -- formatting -------------------------------------------------------------------------------


def nasty(n, seed=1, base=1000):
    r = random.Random(seed)
    text = lambda: "".join(r.choice(CONTROL) for _ in range(r.randint(0, 7)))
    rows = []
    for c in range(base, base + n):
        rows += [(c, t, r.choice(["user", "assistant", "system", "tool", text(), None]), r.choice([text(), text(), None])) for t in range(r.randint(1, 6))]
    return rows


def test_what_is_formatted_reads_back(spark):
    rows = nasty(400)
    found = cf.read_back(cf.formatted(spark.createDataFrame(rows, SCHEMA).orderBy(F.rand(3)))).collect()
    own = {c: [(r or "", t or "") for _, _, r, t in g] for c, g in itertools.groupby(rows, lambda x: x[0])}
    assert len(found) == len(own)
    for r in found:
        assert [(t.role, t.text) for t in r.turns] == own[r.conv_id]
        assert r.formatted == "".join(s.text for s in r.segments)
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>\n") == len(own[r.conv_id])
        assert r.learned == [t for role, t in own[r.conv_id] if role == "assistant"]


def walked(roles, template=cf.CHATML):
    state, broke = cf.START, None
    for k, role in enumerate(roles):
        state = template.moves.get((state, role), cf.INVALID)
        broke = k if broke is None and state == cf.INVALID else broke
    return state, state in template.accepting, broke


def test_the_automaton_judges_every_order(spark):
    kinds = ["user", "assistant", "system", "tool", "other"]
    orders = [o for n in range(1, 5) for o in itertools.product(kinds, repeat=n)]
    rows = [(c, t, role, "x") for c, o in enumerate(orders) for t, role in enumerate(o)]
    for r in cf.formatted(spark.createDataFrame(rows, SCHEMA)).collect():
        assert (r.state, r.valid, r.broke_at) == walked(orders[r.conv_id])


def test_another_template(spark):
    own = cf.Template("[#t]", ": ", "[#/]\n", ("bot", "helper"), {(cf.START, "me"): "open", ("open", "bot"): cf.START}, (cf.START, "open"))
    rows = [(1, 0, "me", "a [#b[\\#/]"), (1, 1, "bot", ": "), (1, 2, "a: b%#", "[")]
    r = cf.read_back(cf.formatted(spark.createDataFrame(rows, SCHEMA), own), own).first()
    assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in rows] and r.learned == [": "] and r.broke_at == 2
    for wrong in ({"end": "</s>"}, {"end": "<|im_start|>."}, {"begin": "||x"}, {"body": ""}, {"body": "é"}, {"body": "<"}):
        with pytest.raises(ValueError):
            cf.Template(**wrong)


def digests(rows):
    text = "".join(f"{r}\n{t}\n" for r, t in rows)
    loss = "".join(t for r, t in rows if r == "assistant")
    return (len(rows), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def written(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("turns", "planted", "segments", "key", "block", "n", "words", "depth")}).write.mode("overwrite").parquet(f"{path}/conversations.parquet")
    return str(path)


#: Null ids, turns, roles and texts, repeated rows, a long text and a long conversation, the added conversation's id.
ODD = [
    (1, 0, "user", "a b"), (1, 1, "assistant", "c"), (1, 1, "assistant", "c"), (2, None, "user", None), (2, 0, None, ""), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (-1, 0, "user", "mine"),
    (3, 0, "user", "w " * 100_000), *((4, t, "user" if t % 2 == 0 else "assistant", f"t{t % 3}") for t in range(700)), (20, 0, "user", "a"), (24, 0, "user", "a"), (21, 5, "tool", " \t"),
]


def test_op11_on_odd_rows_and_its_sql(spark, tmp_path):
    at = written(spark, ODD + nasty(60, 5), tmp_path)
    got = cf.op11_chat_format(spark, at)
    rows = {(r.conv_id, r.n_turns, r.turns_sha256): r for r in got.collect()}
    planted = [("user", cf.PLANTED), ("assistant", cf.PLANTED)]
    assert (-1, *digests(planted)[:2]) in rows and (-1, *digests([("user", "mine")])[:2]) in rows
    assert rows[(-1, *digests(planted)[:2])].loss_sha256 == digests(planted)[3]
    mine = {(None, *digests([("user", "x"), ("assistant", "y")])[:2]), (3, *digests([("user", "w " * 100_000)])[:2])}
    assert mine <= set(rows)
    assert against_sql(got, cf.OP11_SQL, at)


def test_op11_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    r = cf.op11_chat_format(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0].conv_id == -1 and r[0].valid and r[0].n_turns == 2
    assert pt.op12_prefix_trie(spark, str(tmp_path)).count() == 0


def against_sql(got, sql, at):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{at}/conversations.parquet/*.parquet'")
    want = con.sql(sql)
    assert sorted(want.columns) == sorted(got.columns)
    return sorted(map(str, map(tuple, got.select(want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_formatting_runs_no_python(spark, sf):
    plan = cf.op11_chat_format(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan


# -- prefix trie ------------------------------------------------------------------------------


def rebuilt(rows):
    """conv_id to turns, by the contract."""
    own = {}
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest())
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[c][h:]
    return out


def brute(convs):
    """The trie, node by node."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, own in members.items():
        below = [x for x in members if x[: len(node)] == node]
        ends = sorted(c for c in own if len(convs[c]) == len(node))
        out.append((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own), sum(len(x) == len(node) + 1 for x in below),
            sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members) for x in below),
            sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_equals_brute_force(spark):
    r = random.Random(8)
    rows = []
    for c in r.sample(range(-60, 30_000), 250):
        turns = r.randint(1, 4) if r.random() < 0.9 else r.randint(5, 9)
        rows += [(c, t, r.choice("ua"), r.choice(["x", "x y", "a b\tc", "", None])) for t in range(turns)]
    rows += [(c, 0, "u", "the common turn") for c in range(40_000, 40_300)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for shared, convs in ((pt.common.crc32_mod("conv_id", 4).cast("int"), rebuilt(rows)), (None, plain(rows))):
        got = pt.trie(pt.paths(pt.turns_of(frame), shared)).select(COLUMNS).collect()
        assert sorted(map(tuple, got), key=str) == brute(convs)


def plain(rows):
    out = {}
    for c, _, role, text in rows:
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def test_hot_and_other_nodes_agree(spark, monkeypatch):
    rows = [(c, t, "u", f"{c % 3 if t < 2 else c % 50} w") for c in range(300) for t in range(4)]
    frame = spark.createDataFrame(rows, SCHEMA)
    results = []
    for hot in (1, 20, 1_000_000):
        monkeypatch.setattr(pt, "HOT", hot)
        results.append(sorted(map(tuple, pt.trie(pt.paths(pt.turns_of(frame))).select(COLUMNS).collect()), key=str))
    assert results[0] == results[1] == results[2] == brute(plain(rows))


def test_runs_of_ids_are_joined_in_order(spark):
    ids = [-9000, -5, 0, 7, 10, 4095, 4096, 9_000_000, 2**60]
    r = pt.trie(pt.paths(pt.turns_of(spark.createDataFrame([(c, 0, "u", "same") for c in ids], SCHEMA)))).filter("depth = 1").first()
    assert r.ends_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.n_convs == len(ids)


def test_op12_on_odd_rows_and_its_sql(spark, tmp_path):
    rows = [r for r in ODD if r[0] != 4] + [r for r in ODD if r[0] == 4][:40] + nasty(60, 6)
    at = written(spark, rows, tmp_path)
    got = pt.op12_prefix_trie(spark, at)
    assert sorted(map(tuple, got.select(COLUMNS).collect()), key=str) == brute(rebuilt(rows))
    assert against_sql(got, pt.OP12_SQL, at)
