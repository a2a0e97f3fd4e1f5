"""The operators against plain versions of what they promise, on small tables with every odd case."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kerbline.llm import bin_slack, bpe_automaton, histogram_sort, kneser_ney, near_dedup, rules, segments, suffix_dedup, syncmers, toxicity, tree_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def by_row(found, key=lambda r: r.doc_id):
    out = collections.defaultdict(list)
    for r in found:
        out[key(r)].append(r)
    return out


def test_repeated_windows_of_bytes_by_count():
    rng = np.random.default_rng(1)
    for _ in range(60):
        length, letters = int(rng.integers(8, 14)), rng.choice([1, 2, 3, 250])
        parts = [rng.integers(0, letters, rng.integers(length, length + 60)).astype(np.uint8) for _ in range(rng.integers(1, 6))]
        copies, first = rng.integers(1, 3, len(parts)), np.append(0, np.cumsum([len(p) for p in parts]))
        seen = collections.Counter()
        for part, n in zip(parts, copies, strict=True):
            for i in range(len(part) - length + 1):
                seen[part[i : i + length].tobytes()] += n
        want = [i <= len(p) - length and seen[p[i : i + length].tobytes()] > 1 for p in parts for i in range(len(p))]
        assert suffix_dedup.repeated_windows(np.concatenate(parts), first, copies, length).tolist() == want


def test_suffix_order_is_the_order_of_the_texts():
    rng = np.random.default_rng(2)
    data = np.append(rng.integers(97, 99, 400).astype(np.uint8), np.zeros(8, np.uint8))
    order = suffix_dedup.suffix_order(data, np.array([0, 400]), np.array([301]), 100)
    texts = [data[i : i + 100].tobytes() for i in order if i < 301]
    assert texts == sorted(texts) and len(texts) == 301


def test_repeats_go_everywhere(docs, rows):
    seen = collections.Counter()
    raw = [(i, t.encode()) for i, t in rows]
    for _, b in raw:
        for k in range(len(b) - 199):
            seen[b[k : k + 200]] += 1
    want = collections.Counter()
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        want[i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone, strict=True) if not g)] += 1
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == want


@pytest.mark.parametrize("crowded", [20_000, 0])
def test_passages_stay_in_the_first_document(docs, rows, crowded, monkeypatch):
    if not crowded:  # every group is dealt out window by window
        whole = tree_dedup.contents
        monkeypatch.setattr(tree_dedup, "contents", lambda *a: whole(*a, crowded=0))
    least = -(2**63)
    low = {}
    words = [(i, WORD.findall(t)) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - 49):
            low[tuple(w[k : k + 50])] = min(low.get(tuple(w[k : k + 50]), 2**63), least if i is None else i)
    want = collections.Counter()
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if low[tuple(w[k : k + 50])] < (least if i is None else i):
                gone[k : k + 50] = [True] * 50
        want[i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)] += 1
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in tree_dedup.remove_passages(docs).collect())
    assert got == want


def test_prefix_parts_keep_equal_windows_together():
    tokens = np.random.default_rng(3).integers(0, 3, 3000).astype(np.uint64)
    want = tree_dedup.first_documents(tokens, np.array([0, 1500, 3000]), np.array([4, 2]), 8)
    assert (tree_dedup.first_documents(tokens, np.array([0, 1500, 3000]), np.array([4, 2]), 8, most=5) == want).all()


def test_byte_tokens_are_the_library_s(docs, rows):
    tokenizer = Tokenizer.from_file(BYTES)
    want = collections.Counter()
    for i, t in rows:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        want[i, tuple(ids), tokenizer.decode(ids, skip_special_tokens=False)] += 1
    assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe_automaton.encode_and_decode(docs, BYTES).collect()) == want


@pytest.mark.parametrize("letters", ["'  \nsterlmdv1.", "aeioustrnl", " \t'abcXYZéß中01.,-_=/\\😀　\x1c\x85"])
def test_both_tokenizers_on_random_texts(letters):
    rng = random.Random(letters)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 50))) for _ in range(600)]
    for made, path in ((bpe_automaton.codec_of(open(BYTES).read()), BYTES), (bin_slack.encoder_of(open(WORDS).read()), WORDS)):
        ids, first = made.encode(texts)
        library = Tokenizer.from_file(path)
        for k, text in enumerate(texts):
            assert ids[first[k] : first[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_packing_places_every_piece(docs, rows):
    tokenizer = Tokenizer.from_file(WORDS)
    want, total = collections.Counter(), 0
    for i, t in rows:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        total += len(ids)
        for piece, start in enumerate(range(0, len(ids), 4096)):
            own = np.array(ids[start : start + 4096], "<u4")
            want[i, piece, start, len(own), zlib.crc32(own.tobytes())] += 1
    got = bin_slack.pack(docs, WORDS).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = by_row(got, lambda r: r.sequence_id)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len(bins) <= -(-total // 4096) + 1


def test_a_bin_is_as_full_as_can_be():
    rng = random.Random(4)
    for _ in range(40):
        lengths = [rng.randrange(1, 30) for _ in range(8)]
        left = dict(collections.Counter(lengths))
        first = max(lengths)
        taken = bin_slack.fullest(first, sorted(left, reverse=True), left, 60)
        rest = sorted(lengths)
        rest.remove(first)
        best = max(first + sum(x for k, x in enumerate(rest) if m >> k & 1) for m in range(1 << len(rest)) if first + sum(x for k, x in enumerate(rest) if m >> k & 1) <= 60)
        assert sum(n * k for n, k in taken.items()) == best
        assert all(k <= left[n] for n, k in taken.items())


def test_statistics_by_hand(docs, rows):
    want = collections.Counter()
    for i, t in rows:
        w = WORD.findall(t)
        threes = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if threes[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(lines), len(set(w)), failed] += 1
    got = rules.statistics(docs).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines, r.n_different, r.base_failed) for r in got) == want


def test_learned_rules_are_precise_and_ordered(spark):
    rng = np.random.default_rng(6)
    x = {n: rng.random(3000) for n in rules.SHARES}
    bad = (x["symbols_of_word"] > 0.8) | ((x["capitals_of_chars"] > 0.7) & (x["repeated_lines"] < 0.3))
    found = rules.learn(x, bad)
    hit = np.zeros(3000, bool)
    for rule in found:
        hit |= rules.covered(rule, x)
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.02 * hit.sum()
    assert str(rules.verdict(found)).count("WHEN") >= len(found)
    assert rules.learn(x, np.zeros(3000, bool)) == []


def test_rules_keep_good_documents(docs, labels):
    kept = {r.doc_id for r in rules.keep(docs, labels).select("doc_id").collect()}
    judged = {r.doc_id: r.kept for r in rules.judge(docs, labels).collect() if r.doc_id != 1018 and r.doc_id != 1019}
    assert all((i in kept) == k for i, k in judged.items())
    assert rules.keep(docs, labels).columns == docs.columns


def test_near_duplicates_by_all_pairs(docs, rows):
    sets, lower = {}, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for k, (_, t) in enumerate(rows):
        w = WORD.findall(t.translate(lower))
        sets[k] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    group = list(range(len(rows)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in sets:
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                group[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    want = collections.Counter()
    for k, (i, _) in enumerate(rows):
        component = least.get(top(k), i) if sets[k] else i
        want[i, len(sets[k]), component, i is None or component == i] += 1
    got = near_dedup.near_duplicates(docs).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    stay = collections.Counter(r.doc_id for r in near_dedup.keep_one(docs).collect())
    assert stay[1006] == 1 and not stay[1008] and not stay[1009] and stay[1019] + stay[1012] <= 2 and stay[1000] == stay[1001] == 1


def test_shards_have_near_equal_bytes(docs, rows):
    got = histogram_sort.shard(docs, 8).collect()
    want = collections.Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    shards = by_row(got, lambda r: r.shard)
    assert set(shards) <= set(range(8)) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    largest, total = max(r.size for r in got), sum(r.size for r in got)
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 8) <= largest + total / 8 * 0.001


def test_fingerprints_follow_their_texts(docs, rows):
    got = by_row(syncmers.fingerprints(docs).collect())
    order = sorted(rows, key=lambda r: (-(-(2**63) if r[0] is None else r[0]), r[1]))
    parts = lambda f: {f[k : k + 8] for k in range(0, len(f), 8)}
    alike = lambda a, b: len(parts(a) & parts(b)) / len(parts(a) | parts(b)) if a or b else 1.0
    print_of = {}
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert any(r.n_chars == len(t) and r.edited == edited for r in got[i])
        r = next(r for r in got[i] if r.n_chars == len(t) and r.edited == edited)
        assert print_of.setdefault(t, r.fingerprint) == r.fingerprint
        assert abs(r.near_edited - alike(r.fingerprint, r.edited_fingerprint)) < 1e-9
        assert bool(r.fingerprint) == bool(WORD.search(t)) and len(r.fingerprint) % 8 == 0
    assert len(got) == len({i for i, _ in rows})


def test_anchors_do_not_depend_on_where_a_stretch_stands(spark):
    rng = random.Random(8)
    words = [str(rng.randrange(10**6)) for _ in range(200)]
    table = spark.createDataFrame([(" ".join(words),), ("some words before " + " ".join(words),)], "text string")
    a, b = (r.a for r in table.select(syncmers.anchors(table.text).alias("a")).collect())
    assert a == b[-len(a) :] and 0.35 * 200 < len(a) < 0.65 * 200


def kneser_ney_by_hand(text):
    """The model in dictionaries, for whole strings of symbols."""
    order = kneser_ney.ORDER
    padded = "\0" * (order - 1) + text
    levels = {order: collections.Counter(padded[k : k + order] for k in range(len(text)))}
    for n in range(order - 1, 0, -1):
        levels[n] = collections.Counter(g[1:] for g in levels[n + 1])

    def discount(n, c):
        many = [sum(1 for v in levels[n].values() if v == j) for j in (1, 2, 3, 4)]
        return kneser_ney.Discounts.of(np.array(many)).values[min(c, 3)]

    def prob(gram):
        n = len(gram)
        lower = prob(gram[1:]) if n > 1 else 1 / kneser_ney.SYMBOLS
        own = {g: c for g, c in levels[n].items() if g[:-1] == gram[:-1]}
        if not own:
            return lower
        total, c = sum(own.values()), own.get(gram, 0)
        return ((c - discount(n, c)) if c else 0) / total + sum(discount(n, x) for x in own.values()) / total * lower

    return prob


def test_kneser_ney_by_hand_and_sums_to_one(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abc d") for _ in range(400))
    prob = kneser_ney_by_hand(text)
    assert abs(sum(prob("\0abc"[:0] + text[10:14] + chr(s)) for s in range(kneser_ney.SYMBOLS)) - 1) < 1e-9
    other = "abc dabé cab"
    # Documents of the training fold: the model is trained on one of them, the other only asks.
    ids = [i for i in range(60) if kneser_ney.mix(np.array([i], np.uint64))[0] % np.uint64(10) != 0][:2]
    table = spark.createDataFrame([(ids[0], text, "en"), (ids[1], other, "en"), (None, None, None)], "doc_id long, text string, lang string")
    good = spark.createDataFrame([(ids[0], 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in kneser_ney.scores(table, good).collect()}
    padded = "\0" * (kneser_ney.ORDER - 1) + other
    want = np.exp(-np.mean([np.log(prob(padded[k : k + kneser_ney.ORDER])) for k in range(len(other))]))
    assert abs(got[ids[1]].perplexity / want - 1) < 1e-4
    assert got[None].perplexity is None and got[ids[0]].trusted == 1 and got[ids[1]].trusted == 0


def test_many_blocks_and_salts_give_the_same_scores(docs, labels, monkeypatch):
    one = {(r.doc_id, r.n_chars): r.perplexity for r in kneser_ney.scores(docs, labels).collect()}
    monkeypatch.setattr(kneser_ney, "BLOCKS_OF_SALT", 4)
    many = {(r.doc_id, r.n_chars): r.perplexity for r in kneser_ney.scores(docs, labels, block_bytes=60_000).collect()}
    assert one.keys() == many.keys()
    assert all(a is None and many[k] is None or abs(a / many[k] - 1) < 1e-3 for k, a in one.items())


def test_classifier_keeps_good_documents(spark):
    folder = "/root/testdata/sf0.01"
    documents, marks = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    quality = {r.doc_id: r.quality for r in marks.collect()}
    got = kneser_ney.classify(documents, marks).collect()
    kept = [r.kept for r in got if quality.get(r.doc_id) == 1]
    gone = [not r.kept for r in got if quality.get(r.doc_id) == 0]
    assert sum(kept) >= 0.99 * len(kept) and sum(gone) >= 0.6 * len(gone)


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    documents, marks = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    toxic = {r.doc_id: r.toxic for r in marks.collect()}
    got = toxicity.toxicity(documents, marks).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(toxic[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in toxic]
    assert sum(p for t, p in held if t) >= 0.8 * sum(t for t, _ in held)
    assert sum(p for t, p in held if not t) <= 0.01 * len(held)


def test_toxicity_of_odd_rows(docs, labels, rows):
    got = toxicity.toxicity(docs, labels, toxicity.Settings(bits=14)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.toxicity(docs, labels.filter("toxic = 0")).collect()
    assert {r.predicted for r in none} == {0}


def test_empty_tables(nothing, labels):
    assert suffix_dedup.remove_repeats(nothing).count() == 0
    assert histogram_sort.shard(nothing).count() == 0
    assert tree_dedup.remove_passages(nothing).count() == 0
    assert bpe_automaton.encode_and_decode(nothing, BYTES).count() == 0
    assert bin_slack.pack(nothing, WORDS).count() == 0
    assert toxicity.toxicity(nothing, labels).count() == 0
    assert rules.judge(nothing, labels).count() == 0
    assert syncmers.fingerprints(nothing).count() == 0
    assert near_dedup.near_duplicates(nothing).count() == 0
    assert kneser_ney.classify(nothing, labels).count() == 0
    assert kneser_ney.classify(nothing, labels.limit(0)).count() == 0


def test_digests_of_the_queries(spark):
    from kerbline.llm import queries

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(BYTES)
    for r in queries.QUERIES["op5_bpe_round_trip"](spark, folder).collect():
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_the_pipeline_joins_near_copies_from_80_percent_on(spark):
    import corpus_pipeline

    rng = random.Random(12)
    words = [str(rng.randrange(10**6)) for _ in range(204)]

    def edited(at, number):
        return (number, " ".join("other" if k in at else w for k, w in enumerate(words)))

    # 200 shingles, 5 less with each edit: 180 / 220 is 0.818, 175 / 225 is 0.778.
    pair = [edited((), 1), edited((30, 60, 90, 120), 2)]
    apart = [edited((), 1), edited((30, 60, 90, 120, 150), 2)]
    stay = lambda rows: {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert stay(pair) == {1} and stay(apart) == {1, 2}
    assert all(r.kept for r in near_dedup.near_duplicates(spark.createDataFrame(pair, "doc_id long, text string")).collect())


def test_classifier_errs_little_either_way(spark):
    folder = "/root/testdata/sf0.1"
    documents, marks = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    quality = {r.doc_id: r.quality for r in marks.collect()}
    got = kneser_ney.classify(documents, marks).collect()
    fold = lambda i: kneser_ney.mix(np.array([i], np.uint64))[0] % np.uint64(10) == 0
    gone = [not r.kept for r in got if quality.get(r.doc_id) == 0]
    lost = [not r.kept for r in got if quality.get(r.doc_id) == 1 and fold(r.doc_id)]
    assert sum(gone) >= 0.95 * len(gone) and sum(lost) <= 0.04 * len(lost)


def test_one_odd_trusted_text_sets_no_limit(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choice(["lane", "sign", "road", "frame"]) for _ in range(60)), "en" if i % 9 else "de") for i in range(1200)]
    held = [i for i, _, lang in rows if lang == "de" and kneser_ney.mix(np.array([i], np.uint64))[0] % np.uint64(10) == 0]
    noise = lambda: "".join(chr(rng.randrange(33, 700)) for _ in range(300))
    rows[held[0]] = (held[0], noise(), "de")
    bad = [(5000 + i, noise(), "de") for i in range(20)]
    good = spark.createDataFrame([(i, 1) for i, _, _ in rows], "doc_id long, quality int")
    got = kneser_ney.classify(spark.createDataFrame(rows + bad, "doc_id long, text string, lang string"), good).collect()
    assert 2 < len(held) < 50 and not any(r.kept for r in got if r.doc_id >= 5000)


@pytest.mark.parametrize("operator, unit, length, gram, run", [(suffix_dedup, "byte", 200, 64, 256), (tree_dedup, "word", 50, 10, 128)])
def test_a_passage_between_many_neighbours_gathers_nowhere(spark, operator, unit, length, gram, run, monkeypatch):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8)))
    passage = " ".join(word() for _ in range(70))
    table = spark.createDataFrame([(i, " ".join([*(word() for _ in range(60)), passage, *(word() for _ in range(60))])) for i in range(60)], "doc_id long, text string")
    kind = segments.Kind(unit, length, gram, run)
    found = segments.candidates(table, kind, across=unit == "word")
    rows, windows = segments.contents(segments.pack(table), found, kind, crowded=20)
    assert max([r["count"] for r in rows.groupBy("group").count().collect()], default=0) <= 20 and windows.count()
    remove = operator.remove_repeats if unit == "byte" else operator.remove_passages
    want = sorted(remove(table).drop("rid").collect())
    monkeypatch.setattr(operator, "contents", lambda *a: segments.contents(*a, crowded=20))
    assert sorted(remove(table).drop("rid").collect()) == want and sum(r.n_removed > 0 for r in want) >= 59


def test_a_common_line_makes_no_candidates(spark):
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8)))
    *lines, passage = (" ".join(word() for _ in range(n)) for n in [20] * 10 + [60])
    texts = [" ".join([*(word() for _ in range(60)), part, *(word() for _ in range(60))]) for part in lines * 3 + [passage] * 2]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    taken = []
    whole, tree_dedup.candidates = tree_dedup.candidates, lambda *a, **b: taken.append(whole(*a, **b)) or taken[-1]
    try:
        got = {r.doc_id: r.n_removed for r in tree_dedup.remove_passages(table).collect()}
    finally:
        tree_dedup.candidates = whole
    assert got == {**dict.fromkeys(range(31), 0), 31: 60}
    assert 0 < taken[0].filter("doc_id >= 30").count() and not taken[0].filter("doc_id < 30").count()


def test_repeats_of_crowded_keys_by_windows(docs, monkeypatch):
    want = collections.Counter(suffix_dedup.remove_repeats(docs).collect())
    monkeypatch.setattr(suffix_dedup, "contents", lambda *a: segments.contents(*a, crowded=0))
    assert collections.Counter(suffix_dedup.remove_repeats(docs).collect()) == want


def test_a_hot_id_fills_no_block(spark):
    rows = [(i, f"text number {i} " * 20, "en") for i in range(200)] + [(7, "the hot text " * 30, "en")] * 300 + [(None, "no number here " * 30, "en")] * 300
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    good = spark.createDataFrame([(i,) for i in range(0, 200, 7)], "doc_id long")
    dealt, told = kneser_ney.placed(table, good, 40, 8_000)
    size = {r.block: r.size for r in dealt.groupBy("block").count().withColumnRenamed("count", "size").collect()}
    assert sum(size.values()) == len(rows) and max(size.values()) < 60
    at = collections.defaultdict(set)
    for r in told.collect():
        at[r.doc_id].add(r.block)
    trusted = {r[0] for r in good.collect()}
    assert all(r.block in at[r.doc_id] for r in dealt.filter("doc_id IS NOT NULL").collect() if r.doc_id in trusted)


def test_hot_ids_have_the_same_scores_in_many_blocks(spark, monkeypatch):
    rows = [(i, f"text number {i} of some " * 20, "en") for i in range(60)] + [(7, "the hot text " * 30, "en")] * 90 + [(None, "no number " * 30, "en")] * 90
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    good = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    found = lambda size: collections.Counter((r.doc_id, r.n_chars, r.trusted, round(r.perplexity, 3)) for r in kneser_ney.scores(table, good, block_bytes=size).collect())
    one = found(32 << 20)
    monkeypatch.setattr(kneser_ney, "BLOCKS_OF_SALT", 3)
    monkeypatch.setattr(kneser_ney, "COMBINED", 4)
    assert found(6_000) == one and sum(one.values()) == len(rows)


def regular_pair(length: int) -> tuple[str, str]:
    """Two different words of a and b whose polynomial hashes modulo a power of two are equal, whatever the base."""
    first = [bin(i).count("1") % 2 for i in range(length)]
    return "".join("ab"[x] for x in first), "".join("ba"[x] for x in first)


def test_regular_texts_do_not_collide(spark):
    one, other = regular_pair(4096)
    from kerbline.llm import arrays, wordsplit

    assert rules.counts_of(arrays.texts_of(pa.array([f"{one}\n{other}"])))["n_dup_lines"].tolist() == [0]
    assert len(set(segments.tokens_of(arrays.texts_of(pa.array([f"{one} {other}"])), "word")[0].tolist())) == 2
    assert wordsplit.split([f"{one} {other}"], keep_white=True).words == [one, " " + other]
    sets, first = near_dedup.shingle_sets(arrays.texts_of(pa.array([one, other])), 5)
    assert len(set(sets.tolist())) == 2 and first.tolist() == [0, 1, 2]
    values = arrays.byte_values()[np.frombuffer((one + other).encode(), np.uint8)]
    grams = arrays.Hashes(values).grams(4096)
    assert grams[0] != grams[4096]
    kind = segments.Kind("byte", 2048, 32, 4096)
    seg = segments.runs_of(np.concatenate([values, values[:1]]), np.array([0, 4096, 8193]), kind)["seg"]
    assert len(set(seg.tolist())) == len(seg)


def test_grams_and_stretches_depend_on_all_their_values():
    from kerbline.llm import arrays

    rng = np.random.default_rng(8)
    values = rng.integers(0, 4, 3000).astype(np.uint64) + np.uint64(7)
    for k in (1, 2, 3, 5, 32, 50, 200):
        grams = arrays.Hashes(arrays.mix(values.copy())).grams(k)
        texts = [values[i : i + k].tobytes() for i in range(len(values) - k + 1)]
        assert len(grams) == len(texts) and len(set(zip(texts, grams.tolist(), strict=True))) == len(set(texts)) == len(set(grams.tolist()))
    start = rng.integers(0, 2500, 2000)
    size = rng.integers(0, 400, 2000)
    hashes = arrays.Hashes(arrays.mix(values.copy())).between(start, start + size)
    texts = [values[a : a + n].tobytes() for a, n in zip(start, size, strict=True)]
    assert len(set(zip(texts, hashes.tolist(), strict=True))) == len(set(texts)) == len(set(hashes.tolist()))
    edges = np.sort(rng.integers(0, 3001, 900))
    start, end = edges[:-1], edges[1:] - (rng.integers(0, 2, 899) & (np.diff(edges) > 0))
    sequence = arrays.Hashes(arrays.mix(values.copy()))
    assert (sequence.apart(start, end) == sequence.between(start, end)).all()


@pytest.mark.parametrize("percent", [80, 85])
def test_no_similar_pair_fails_to_meet(spark, percent):
    """Sets of all sizes around a few centres: every similar pair of different parts meets, and few others do."""
    rng = random.Random(percent)
    sets = []
    for centre in range(6):
        base = [rng.randrange(10**9) for _ in range(rng.choice([1, 4, 20, 60, 120]))]
        for _ in range(25):
            own = set(base)
            for _ in range(rng.randrange(8)):
                own.discard(rng.choice(base))
                if rng.random() < 0.7:
                    own.add(rng.choice(base) + rng.randrange(1, 4))
            sets.append(own or {centre})
    rows = [(i, i if i % 9 else 0, sorted(s)) for i, s in enumerate(sets)]
    met = near_dedup.meeting(spark.createDataFrame(rows, "cls long, part long, items array<long>"), percent).distinct().collect()
    got = {(r.u, r.v) for r in met}
    apart = [(u, v) for u in range(len(sets)) for v in range(u) if rows[u][1] != rows[v][1]]
    want = {(v, u) for u, v in apart if 100 * len(sets[u] & sets[v]) >= percent * len(sets[u] | sets[v])}
    assert want and want <= got and len(got) < len(apart) / 4
    assert all(u < v and rows[u][1] != rows[v][1] for u, v in got)


def test_a_repeated_id_teaches_once(docs, labels, spark):
    one = labels.filter("quality = 0 AND toxic = 1").first() or labels.first()
    many = docs.unionByName(docs.filter(F.col("doc_id") == one.doc_id).crossJoin(spark.range(40)).drop("id"))
    rows = rules.statistics(many)
    fitted = rules.fit(rows, labels, 12_000)
    assert fitted == rules.fit(rules.statistics(docs), labels, 12_000)
    scores = [{(r.doc_id, round(r.score, 9)) for r in toxicity.toxicity(d, labels).collect()} for d in (docs, many)]
    assert scores[0] == scores[1]


def test_every_stage_form_on_an_empty_table(nothing, labels):
    for kept in (rules.keep(nothing, labels), kneser_ney.keep(nothing, labels), near_dedup.keep_one(nothing), tree_dedup.without_passages(nothing)):
        assert kept.collect() == [] and set(nothing.columns) <= set(kept.columns)


def test_a_language_with_few_texts_leans_on_all(docs, labels):
    own = kneser_ney.classify(docs, labels, enough_texts=1).groupBy("lang").agg(F.max("threshold").alias("t")).collect()
    pooled = kneser_ney.classify(docs, labels, enough_texts=10**9).groupBy("lang").agg(F.max("threshold").alias("t")).collect()
    between = {r.lang: r.t for r in kneser_ney.classify(docs, labels).groupBy("lang").agg(F.max("threshold").alias("t")).collect()}
    for a, b in zip(sorted(own, key=lambda r: r.lang or ""), sorted(pooled, key=lambda r: r.lang or ""), strict=True):
        assert a.lang == b.lang and min(a.t, b.t) - 1e-9 <= between[a.lang] <= max(a.t, b.t) + 1e-9
