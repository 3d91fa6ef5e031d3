"""Line dedup, near copies, repeated strings, licences and packing against brute force on hard little tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.llm import license_scan, line_dedup, mixing, ngram_jaccard, packing, quality_classifier, substring_dedup

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep string, rep bigint, n bigint, row int, w string"
LINE = "This line is long enough to be counted as a shared line of text"


def table(spark, texts):
    """Documents with columns whose names clash with those that the operators use inside."""
    rows = [(i, t, "en", "s", len(t or ""), "x", 7, 8, 9, "y") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def texts():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    base = " ".join(word() for _ in range(300))
    out = [(0, None), (1, ""), (2, " \n\t \n"), (3, "one"), (4, "one two"), (5, "ONE two"), (6, "Ünï çödé " * 30)]
    for k in range(12):
        tokens = base.split()
        for j in rng.integers(0, 300, k):
            tokens[j] = word()
        out.append((10 + k, " ".join(tokens)))
    out += [(30 + k, f"{LINE}\n  {LINE.upper()}  \nown line {word()} {word()} {word()} {word()} {word()} {word()}") for k in range(7)]
    out += [(50, base), (51, base), (52, base + " " + base), (53, "ab " * 400), (54, " ".join(word() for _ in range(20000)))]
    return out


def test_line_dedup(spark):
    rows = texts()
    keys = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
            key = "".join(c.lower() if "A" <= c <= "Z" else c for c in key)
            if len(key) >= 40:
                keys.setdefault(key, set()).add(i)
    key_of = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    kept = {i: [x for x in (t or "").split("\n") if not (len(keys.get(key_of(x), ())) >= 5 and max(keys[key_of(x)]) != i)] for i, t in rows}
    got = {r.row.doc_id: (len(r.all_lines), r.kept) for r in line_dedup.with_kept_lines(table(spark, rows)).collect()}
    assert got == {i: (len((t or "").split("\n")), kept[i]) for i, t in rows}
    assert len(kept[30]) == 1 and len(kept[36]) == 3
    cut = line_dedup.drop_lines(table(spark, rows))
    assert cut.columns == table(spark, rows[:1]).columns and cut.count() == len(rows)


def test_line_dedup_null_ids_repeats_and_no_rows(spark):
    rows = [(None, LINE)] * 5 + [(1, LINE)] * 6
    got = line_dedup.with_kept_lines(table(spark, rows)).collect()
    assert len(got) == 11 and all(r.kept == [LINE] for r in got)
    assert line_dedup.drop_lines(table(spark, rows).where("false")).count() == 0


def test_a_hot_line_spreads_over_blocks(spark):
    rows = [(i, f"{LINE}\nown line of document number {i} that is long enough") for i in range(60)]
    keep = {r.doc_id: [w.word for w in r.keep] for r in line_dedup.keep_bitmaps(table(spark, rows), block_rows=7).collect()}
    assert set(keep) == set(range(59)) and all(w == [0] for w in keep.values())


def test_names_of_the_caller_stay(spark):
    names = ["kept", "bitmap", "all_lines", "keep", "is_kept", "p_clean", "times", "turn", "w", "copy", "each", "of", "lost", "print"]
    docs = table(spark, [(i, f"{LINE}\nrest of document {i}") for i in range(8)] + [(9, None)])
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(f"mine{k}"))
    mine = [f"mine{k}" for k in range(len(names))]
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    frames = [line_dedup.drop_lines(docs), quality_classifier.acceptable(docs, quality_classifier.fit(docs, none)), mixing.resampled(docs), ngram_jaccard.one_of_each(docs)]
    for out in frames:
        assert out.columns == docs.columns
        assert all([r[n] for n in docs.columns[10:] if n in names] == [m for n, m in zip(names, mine, strict=True) if n in docs.columns[10:]] for r in out.collect())
    assert [len(r.text.split("\n")) for r in frames[0].orderBy("doc_id").collect() if r.text] == [1] * 7 + [2]


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_near_copies(spark, size, percent):
    rows = texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.near_copies(table(spark, rows), ngram_jaccard.Scheme(size, percent)).collect()}
    want = brute_components(rows, size, percent)
    assert got == want and len({c for _, c in want.values()}) < len(want) - 4


def test_near_copies_null_ids_and_no_rows(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "A b c d")]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_jaccard.near_copies(table(spark, rows)).collect())
    assert got == [("1", 2, 1), ("1", 2, 1), ("2", 2, 1), ("None", 2, None)]
    assert ngram_jaccard.near_copies(table(spark, rows).where("false")).count() == 0
    assert sorted(str(r.doc_id) for r in ngram_jaccard.one_of_each(table(spark, rows)).collect()) == ["1", "1", "None"]


def test_an_isolated_pair_of_small_sets_links(spark):
    scheme = ngram_jaccard.Scheme(5, 80)
    edges, rng, cut = scheme.edges(), np.random.default_rng(11), []
    for k in range(20_000):
        n = 8 + k % 9
        tokens = [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
        a, b = " ".join(tokens), " ".join([*tokens, "more"] if k % 2 else [*tokens[:-1], "other"])
        s, t = (ngram_jaccard.words.shingle_set(x, 5) for x in (a, b))
        both = len(np.intersect1d(s, t))
        if 100 * both < 80 * (len(s) + len(t) - both):
            continue
        (own, *x), (other, *y) = (ngram_jaccard.bucket_keys(z, scheme, edges) for z in (s, t))
        shared = len(np.intersect1d(own, other))
        if shared < max(x[0], y[0]):
            cut.append((a, b, shared >= max(x[-1], y[-1])))
    assert cut and all(c[2] for c in cut)
    got = ngram_jaccard.near_copies(table(spark, [(1, cut[0][0]), (2, cut[0][1])]), scheme).collect()
    assert [r.component_id for r in got] == [1, 1]


def brute_removed(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = [False] * len(data)
        for j in range(len(data) - length + 1):
            if data[j : j + length] in seen:
                gone[j : j + length] = [True] * length
            seen.add(data[j : j + length])
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("bucket", [50_000, 3])
def test_repeated_strings(spark, bucket):
    rows = [r for r in texts() if r[0] != 54]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in substring_dedup.kept_bytes(table(spark, rows), bucket=bucket).collect()}
    assert got == brute_removed(rows, 100)


def test_an_anchor_of_more_spans_than_a_task_compares_at_once(spark):
    made = lambda k, n: "".join(np.random.default_rng(k).choice(list("abcdefgh"), n))
    passage = made(0, 90)  # too short to repeat alone, so that all copies stand in different spans
    rows = [(k, made(k % 7 + 1, 90)[k % 5 :] + passage + made(k + 100, 60)) for k in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = substring_dedup.kept_bytes(table(spark, rows), bucket=3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute_removed(rows, 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found} == want
    assert 0 < sum(x[1] for x in want.values()) < sum(x[0] for x in want.values())


def test_repeated_strings_null_ids_and_repeated_rows(spark):
    long = "".join(np.random.default_rng(1).choice(list("abcdefgh"), 400))
    got = substring_dedup.kept_bytes(table(spark, [(None, long), (3, long), (3, long), (4, long), (5, None)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("3", 0), ("3", 0), ("4", 400), ("5", 0), ("None", 0)]
    assert substring_dedup.kept_bytes(table(spark, [(1, "x")]).where("false")).count() == 0


@pytest.mark.parametrize("bucket", [50_000, 3])
def test_repeated_rows_beside_a_partial_copy(spark, bucket):
    word = lambda rng: "".join(rng.choice(list("abcdefgh"), 400))
    head, tail, other = (word(np.random.default_rng(k)) for k in range(3))
    rows = [(1, head + tail), (1, head + tail), (2, head + other), (2, head + other), (2, other + tail)]
    got = {(r.doc_id, bytes(r.kept)) for r in substring_dedup.kept_bytes(table(spark, rows), bucket=bucket).collect()}
    assert (1, (head + tail).encode()) in got and len(got) == 3
    alone = [(1, head + tail), (2, head + other)]
    want = brute_removed(alone, 100)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in substring_dedup.kept_bytes(table(spark, rows[:4]), bucket=bucket).collect()}
    assert found == want


def test_licenses(spark):
    filler = " ".join(f"word{i}" for i in range(200))
    grant = license_scan.TEMPLATES["mit-grant"][0]
    changed = grant.replace("documentation files", "documentation data")
    rows = [(1, f"{filler} {grant} {filler}"), (2, f"{filler} LICENSED under the Apache\nLicense, Version 2.0. {filler}"), (3, filler), (4, None), (5, ""), (6, f"x {changed}"), (7, "Released under the MIT License"), (8, "All rights reserved. All rights reserved.")]
    found = {(r.doc_id, r.license): r for r in license_scan.scanned(table(spark, rows)).collect()}
    assert set(found) == {(1, "mit-grant"), (2, "apache-2.0"), (6, "mit-grant"), (7, "mit"), (8, "all-rights-reserved")}
    assert found[1, "mit-grant"].containment == 1.0 and 0.8 <= found[6, "mit-grant"].containment < 1
    assert license_scan.scanned(table(spark, rows).where("false")).count() == 0


def test_rows_of_one_id_are_scanned_one_by_one(spark):
    grant = license_scan.TEMPLATES["mit-grant"][0]
    broken = grant.replace(" of charge, to any", " x y z").replace("obtaining a", "u v").replace("associated", "q")
    for rows in ([(None, broken), (None, grant)], [(None, grant), (None, broken)], [(4, broken), (4, grant), (4, grant)]):
        found = license_scan.scanned(table(spark, rows)).collect()
        assert [(r.license, r.containment) for r in found] == [("mit-grant", 1.0)]


def brute_licenses(rows, templates, containment):
    """license and best containment of every text, by all its shingles in windows of twice the class's span."""
    out = {}
    for license_, texts_ in templates.items():
        for text in texts_:
            t = re.findall("[a-z0-9]+", text.lower())
            k = min(5, len(t))
            want = {tuple(t[j : j + k]) for j in range(len(t) - k + 1)}
            span = 1
            while span < len(want):
                span *= 4
            for i, doc in rows:
                w = re.split("[^a-z0-9]+", (doc or "").lower())
                h = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
                for at in range(0, len(h), span):
                    share = len(want & set(h[at : at + (2 * span if span > 1 else 1)])) / len(want)
                    if share >= containment:
                        out[i, license_] = max(share, out.get((i, license_), 0))
    return out


def test_licenses_against_all_windows(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    whole = [t for texts_ in license_scan.TEMPLATES.values() for t in texts_]
    rows = []
    for i in range(120):
        w = whole[i % len(whole)].split()
        for j in rng.integers(0, len(w), rng.integers(0, 1 + len(w) // 12)):
            w[j] = word()
        rows.append((i, " ".join([word() for _ in range(int(rng.integers(0, 80)))] + w + [word() for _ in range(30)])))
    got = {(r.doc_id, r.license): r.containment for r in license_scan.scanned(table(spark, rows)).collect()}
    want = brute_licenses(rows, license_scan.TEMPLATES, 0.8)
    assert got == {k: v for k, v in want.items() if k in got} and len(got) >= 0.99 * len(want) and len(want) > 60


def test_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    tokens = packing.token_bytes(packing.tokenizer_file())
    plain = Tokenizer.from_file(packing.tokenizer_file())
    rng = np.random.default_rng(6)
    letters = [chr(c) for c in range(0x20, 0x250)] + ["\n", " ", " ", "'s", "<|endoftext|>", "1", "2"]
    for _ in range(300):
        text = "".join(rng.choice(letters, 60))
        assert tokens(text) == np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert tokens("a <|endoftext|> b") == np.array([64, 220, 50256, 275], dtype="<u4").tobytes()
    for c in [*range(0x250), 0x2028, 0x3000, 0x4E00, 0x1F600]:
        for text in (f"a{chr(c)}b", f"x {chr(c)}{chr(c)} 1b", f"{chr(c)}\n {chr(c)}'s"):
            assert tokens(text) == np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_packing_is_a_partition_into_gapless_sequences(spark):
    rows = [*texts(), (None, "no id"), (3, "one")]
    tokens = packing.token_bytes(packing.tokenizer_file())
    pieces = [tuple(r) for r in packing.pack(table(spark, rows), capacity=256).collect()]
    want = []
    for i, t in rows:
        ids = np.frombuffer(tokens(t or ""), dtype="<u4").tolist() + [0]
        first = len(ids) % 256 or 256
        bounds = [0, *range(first, len(ids) + 1, 256)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
    order = lambda t: str(t)
    assert sorted((p[:5] for p in pieces), key=order) == sorted(want, key=order)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p[5], []).append((p[6], p[3]))
    for placed in by_sequence.values():
        placed.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(placed, placed[1:], strict=False)) and placed[0][0] == 0 and sum(n for _, n in placed) <= 256
    assert packing.pack(table(spark, rows).where("false")).count() == 0


def test_bins_are_few(spark):
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(6, 1, 20_000).astype(int) % 2047 + 1, 2047)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    plan = packing.plan_bins(histogram)
    used = {}
    for content, bins in plan:
        assert sum(k * n for k, n in content.items()) <= 2048
        for k, n in content.items():
            used[k] = used.get(k, 0) + n * bins
    assert used == histogram
    assert sum(b for _, b in plan) <= 1.005 * -(-lengths.sum() // 2048) + 1
