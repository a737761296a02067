"""The conversation trie against brute force; the radix tree against a dictionary."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from spoor.llm import prefix_trie as pt
from spoor.llm.radix_tree import Direct, Indexed, Node, RadixTree, Sorted

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def kept(node, above=b""):
    here = above + node.prefix
    if node.value is not None:
        yield here, node.value
    for byte, child in node.children.items():
        yield from kept(child, here + bytes([byte]))


def test_radix_tree_holds_its_keys_in_order():
    rng = random.Random(1)
    for letters in (1, 3, 256):
        tree, want = RadixTree(), {}
        for i in range(1500):
            key = bytes(rng.randrange(letters) for _ in range(rng.randrange(0, 6)))
            tree.insert(key, i)
            want[key] = i
        assert list(kept(tree.root)) == sorted(want.items())


def test_layouts_grow_with_their_children():
    layout, kinds = Sorted(), []
    for byte in random.Random(2).sample(range(256), 256):
        layout = layout.put(byte, Node(bytes([byte])))
        kinds.append((type(layout), getattr(layout, "room", None)))
        assert layout.get(byte).prefix == bytes([byte])
    assert kinds[3] == (Sorted, 4) and kinds[4] == kinds[15] == (Sorted, 16)
    assert kinds[16][0] is kinds[47][0] is Indexed and kinds[48][0] is kinds[255][0] is Direct
    assert [b for b, _ in layout.items()] == list(range(256))


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        if conv is not None:
            told = f"{len((role or '').encode())}:{role or ''}{text or ''}"
            own[conv].append((turn is not None, turn or 0, hashlib.md5(told.encode()).digest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(c - 5 * int(c / 5)), [])[:h] + turns[h:]
    return own, out


def brute(conversations):
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        size = len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * size + sum(saved[c] for c in children[node])
    out = []
    for node, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(conversations[c]) == len(node))
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(children[node]),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted([tuple(r) for r in df.collect()], key=str)


def odd_rows():
    rng = random.Random(3)
    says = ["", "hi", "héllo", "bye", None, "what is it"]
    rows = []
    for c in list(range(40)) + [100_003, 200_007, -3, -7, 55]:
        common = rng.choice([[("system", "be kind"), ("user", "hi")], [("user", "hi")], []])
        turns = common + [(rng.choice(["user", "assistant", None]), rng.choice(says)) for _ in range(rng.randrange(0, 9))]
        numbers = [None if rng.random() < 0.05 else k for k in range(len(turns))]
        rows += [(c, k, role, text, "x") for k, (role, text) in zip(numbers, turns)]
    rows += [(500 + i, k, "user", f"same {k}", "y") for i in range(30) for k in range(4)]
    rows += [rows[5], (None, 0, "user", "lost", "z"), (777, 0, "user", "x" * 300_000, "z")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk_paths", [1, 7, 10_000])
def test_equals_brute_force(spark, chunk_paths, monkeypatch):
    monkeypatch.setattr(pt, "ID_RANGE", 9)
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    own, shared = rebuilt(rows)
    turns = pt.conversation_turns(df)
    assert got(pt.prefix_trie(turns, chunk_paths)) == brute(own)
    assert got(pt.prefix_trie(pt.shared_heads(turns), chunk_paths)) == brute(shared)


def test_empty_and_turnless(spark):
    empty = pt.conversation_turns(spark.createDataFrame([], SCHEMA))
    assert got(pt.prefix_trie(empty)) == []
    # 10 takes its first turns from itself, 11 to 14 from 10, which is not there.
    rows = [(c, 0, "user", "hi", None) for c in range(11, 15)]
    _, shared = rebuilt(rows)
    assert [] in shared.values()
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(pt.prefix_trie(pt.shared_heads(pt.conversation_turns(df)))) == brute(shared)
