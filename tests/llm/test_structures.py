"""Prefix tries, byte pairs and Merkle manifests against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.llm import byte_pairs, merkle, packing, prefix_trie

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, k bigint, part string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def brute_trie(rows: list[tuple]) -> set[tuple]:
    own: dict[int, list] = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    members: dict[tuple, list[int]] = {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members.setdefault(built[c][:d], []).append(c)
    nodes = list(members)
    kids = {p: [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p] for p in nodes}
    out = set()
    for p in nodes:
        below = [q for q in nodes if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len([w for w in q[-1][1].replace("\v", " ").replace("\f", " ").split(" ") if w.strip()]) for q in below if q)
        ends = ",".join(str(c) for c in members[p] if len(built[c]) == len(p))
        out.add((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids[p]), sum(not kids[q] for q in below), saved, sha(ends)))
    return out


def found_trie(spark, rows: list[tuple]) -> set[tuple]:
    turns = prefix_trie.staged(prefix_trie.turns_of(spark.createDataFrame([(*r, 9, "x") for r in rows], CONVERSATIONS)), "turns")
    base, h = F.expr("conv_id - conv_id % 20"), F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    got = [tuple(r) for r in prefix_trie.prefix_trie(*prefix_trie.rebuilt(turns, 3, base, h)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def made_conversations() -> list[tuple]:
    r = random.Random(3)
    rows = [(c, t, r.choice("ua"), r.choice(["a b", "c", "", None])) for c in range(45) for t in range(r.choice([0, 1, 2, 3, 9]))]
    rows += [(60 + c, t, "u", f"w{t // 2}") for c in range(12) for t in range(12)]  # long shared beginnings
    rows += [(7, None, None, "null turn first"), (7, None, None, "null turn first"), (None, 1, "u", "no conversation"), (81, 4, "u", "base is absent"), (200, 0, "u", "word " * 5000)]
    return rows


@pytest.mark.parametrize("batch", ["10000", "3"])
def test_trie_is_what_brute_force_finds(spark, batch):
    """Small batches leave chains that only pointer jumping joins."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = made_conversations()
        assert found_trie(spark, rows) == brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_trie_of_nothing(spark):
    assert found_trie(spark, []) == set()
    assert found_trie(spark, [(None, 1, "u", "x")]) == set()


def test_turnless_conversations_end_at_the_root(spark):
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0)
    rows = [(lone, 0, "u", "gone")]
    assert found_trie(spark, rows) == brute_trie(rows) == {(lone, 0, None, 1, 0, 1, 0, sha(str(lone)))}


def test_pointer_jumping_ranks_a_list(spark):
    order = list(range(500))
    random.Random(5).shuffle(order)
    rows = [(a, b, 1 + a % 3) for a, b in zip(order, [*order[1:], None], strict=True)]
    got = {r["id"]: r["to_end"] for r in prefix_trie.ranked(spark.createDataFrame(rows, "id bigint, next bigint, length bigint")).collect()}
    left = 0
    for a in reversed(order):
        left += 1 + a % 3
        assert got[a] == left


def brute_manifest(rows: list[tuple]) -> list[tuple]:
    """(doc_id, leaf, subroot, root, siblings bottom up, slots) by recursion."""

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
        level, paths, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
        while len(level) > 1:
            runs = [level[k : k + 8] for k in range(0, len(level), 8)]
            for i, p in enumerate(paths):
                run, slot = runs[at[i] // 8], at[i] % 8
                p.append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            at = [a // 8 for a in at]
            level = [sha("".join(run)) for run in runs]
        return level[0], paths

    if not rows:
        return []
    groups: dict[str | None, list] = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, sha("".join(map(field, row))), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, above = tree([built[g][0] for g in names])
    out = []
    for g, top in zip(names, above, strict=True):
        for (*_, leaf, row), path in zip(sorted(groups[g], key=lambda x: x[:3]), built[g][1], strict=True):
            out.append((row[0], leaf, built[g][0], root, tuple(path + top)))
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 70, 600])
def test_manifest_is_what_brute_force_builds(spark, n):
    r = random.Random(n)
    rows = [(r.choice([None, *range(n)]), r.choice(["s", None]), r.choice(["en", "de", None, "", "Zz", "é"] if n < 500 else ["en"] * 9 + ["de"]), k, r.choice([f"Text {k}", "", None, "Same"])) for k in range(n)]
    rows += rows[:3] + ([(5, "s", "only one", 1, "x" * 100_000)] if n else [])
    docs = spark.createDataFrame([(*x, "clash", "clash") for x in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, h string, tree string")
    made = merkle.manifest(docs, "doc_id", "lang", merkle.record_hash(*map(F.col, merkle.FIELDS))).withColumn("again", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    got = [(x.doc_id, x.leaf, x.subroot, x.root, tuple(map(tuple, x.path))) for x in made]
    order = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(got, key=order) == sorted(brute_manifest(rows), key=order)
    assert all(x.again == x.root for x in made)
    forged = spark.createDataFrame([tuple(x) for x in made], docs.sparkSession.createDataFrame(made).schema).select((merkle.folded(F.sha2(F.lit("other"), 256), F.col("path")) == F.col("root")).alias("ok")).collect() if made else []
    assert not any(x.ok for x in forged)


@pytest.fixture(scope="module")
def bpe():
    return byte_pairs.codec(byte_pairs.ranks_file())


@pytest.fixture(scope="module")
def library(bpe):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def numbers(raw: bytes) -> list[int]:
    return np.frombuffer(raw, dtype="<u4").tolist()


def one_by_one(model: byte_pairs.Codec, piece: bytes) -> list[int]:
    """The merges of a piece, one leftmost lowest pair after another, by their bytes."""
    if piece in model.ranks:
        return [model.ranks[piece]]
    parts = [bytes([b]) for b in piece]
    while True:
        ranks = [model.ranks.get(a + b, 2**31) for a, b in zip(parts, parts[1:], strict=False)]
        if not ranks or min(ranks) == 2**31:
            return [model.ranks[p] for p in parts]
        k = ranks.index(min(ranks))
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_pieces_merge_as_one_by_one(bpe):
    r = random.Random(8)
    alphabets = ["ab", "thein ", "é漢字かな", "abcdefghijklmnopqrstuvwxyz", "=-", "0123456789", "\U0001f600‍"]
    pieces = ["".join(r.choice(a) for _ in range(r.choice([1, 2, 3, 7, 20, 90, 300]))) for a in alphabets for _ in range(40)]
    assert [numbers(x) for x in bpe.encoded_pieces(pieces)] == [one_by_one(bpe, p.encode()) for p in pieces]


def test_texts_are_encoded_as_the_library_does(bpe, library):
    r = random.Random(9)
    points = [k for k in [*range(0x3100), *range(0x3100, 0x110000, 61)] if not 0xD800 <= k <= 0xDFFF]
    texts = [f"a{chr(k)}b {chr(k)}1{chr(k)} {chr(k)}!\n{chr(k)}'s" for k in points]
    texts += ["".join(r.choice("ab'strelvdm \n\t \x1c.,9é漢") for _ in range(r.choice([0, 1, 5, 60, 2000]))) for _ in range(300)]
    texts += ["<|endoftext|> is text", " " * 3000 + "x", "=" * 5000, "a\n" * 4000]
    assert [numbers(x) for x in bpe.encode(texts)] == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("unit", [" ", "\n", "a", "漢"])
def test_a_million_of_one_character_round_trips(bpe, unit):
    text = "x" + unit * 1_000_000 + "y"
    assert bpe.decode(np.array(numbers(bpe.encode([text])[0]))) == text.encode()


def test_ids_that_no_token_has_are_refused(bpe):
    with pytest.raises(ValueError):
        bpe.decode(np.array([50_256]))


def test_encode_and_decode_tables(spark, library):
    texts = [None, "", "Twice the same", "Twice the same", "é" * 9, "long text " * 300_000]
    rows = [(k if k != 2 else None, t, "clash", "clash") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, bytes string")
    got = byte_pairs.decode(byte_pairs.encode(docs)).collect()
    expected = sorted((str(k), tuple(library.encode_ordinary(t or "")), (t or "").encode()) for k, t, *_ in rows)
    assert sorted((str(x.doc_id), tuple(numbers(bytes(x.ids))), bytes(x.bytes)) for x in got) == expected
    assert byte_pairs.decode(byte_pairs.encode(docs.where("false"))).collect() == []


@pytest.mark.parametrize("unit", [" ", "\t", "\n", " "])
@pytest.mark.parametrize("millions", [1, 3])
def test_long_white_space_is_packed(spark, unit, millions):
    """Runs on which one of the two libraries fails."""
    text = "a" + unit * (millions * 1_000_000) + "b"
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id bigint, text string")
    pieces = packing.pack(docs).collect()
    ids = packing.token_bytes(packing.tokenizer_file()).model.encode(text, add_special_tokens=False).ids
    mine = sorted((p.piece, p.start, p.length) for p in pieces if p.doc_id == 1)
    assert sum(n for *_, n in mine) == len(ids) + 1
    assert [s for _, s, _ in mine] == [sum(n for *_, n in mine[:k]) for k in range(len(mine))]
