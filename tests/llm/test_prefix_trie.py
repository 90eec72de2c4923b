import hashlib
import random
import zlib
from collections import defaultdict

from histora.llm import prefix_trie as trie
from histora.llm.registry import QUERIES

from ..conftest import MEDIUM


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plainly(rows):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, sha(f"{len(role or '')}:{role or ''}{text or ''}"), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = own.get(base, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes[tuple(built[c][:d])].append(c)
    kids = defaultdict(list)
    for key in nodes:
        if key:
            kids[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(nodes, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in kids[key]) or 1
        saved[key] = (len(nodes[key]) - 1) * (len(key[-1][1]) if key else 0) + sum(saved[k] for k in kids[key])
    return sorted(
        (cs[0], len(key), nodes[key[:-1]][0] if key else None, len(cs), len(kids[key]), leaves[key], saved[key], sha(",".join(str(c) for c in cs if len(built[c]) == len(key))))
        for key, cs in nodes.items()
    )


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS d", "'x' AS rep", "'x' AS node", "'x' AS p", "'x' AS size", "'x' AS base")


def result(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()))


def conversations(seed=1, families=4):
    r, out = random.Random(seed), []
    texts = ["", "a", "bb", "é😀", None]
    for base in range(families):
        head = [(r.choice(["user", "assistant", None]), r.choice(texts)) for _ in range(r.randint(0, 8))]
        for c in range(40):
            turns = head[: r.randint(0, 8)] + [(r.choice(["user", "x"]), r.choice(texts)) for _ in range(r.randint(0, 3))]
            if r.random() < 0.3:
                turns = head
            for t, (role, text) in enumerate(turns):
                out.append((base * 100 + c, t if r.random() > 0.02 else None, role, text))
    return out


def test_trie_matches_a_plain_one(spark):
    rows = conversations()
    assert result(trie.prefix_trie(frame(spark, rows))) == plainly(rows)


def test_copies_of_long_conversations_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_IDS", 7)
    long = [("user", f"turn {k}") for k in range(60)]
    rows = [(c, t, *x) for c in (*range(100, 190), 900, -250, -201, 2**63 - 1, -(2**63)) for t, x in enumerate(long)]
    rows += [(1000, t, *x) for t, x in enumerate(long[:30])] + [(1001, t, *x) for t, x in enumerate(long[:12] + [("user", "other")] * 15)]
    rows += [(None, 1, "user", "none")] * 3 + [(5, None, None, None), (5, None, None, None), (5, 1, "user", "x"), (5, 1, "user", "x"), (7, 0, "user", "y"), (300, 1, "user", "y")]
    assert result(trie.prefix_trie(frame(spark, rows))) == plainly(rows)


def test_deep_sharing_takes_a_round_a_shared_turn(spark):
    stem = [("user", f"t{k}") for k in range(14)]
    rows = [(c, t, *x) for c in (100, 200, 300) for t, x in enumerate([*stem, ("user", str(c)), ("user", "end")])]
    assert result(trie.prefix_trie(frame(spark, rows))) == plainly(rows)


def test_only_turnless_conversations_and_no_rows(spark):
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in range(1, 100)}
    rows = [(c, 0, "user", "gone") for c in h if h[c] > 1][:5]
    assert result(trie.prefix_trie(frame(spark, rows))) == plainly(rows) and len(plainly(rows)) == 1
    assert result(trie.prefix_trie(frame(spark, []))) == []


def test_op13_on_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op13_prefix_trie"](spark, MEDIUM)) == plainly(rows)
