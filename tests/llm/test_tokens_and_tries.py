"""Chunked BPE, the conversation trie and token alignment against plain versions, on small tables with every odd case."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from kerbline.llm import align, chunked_bpe, prefix_trie

RANKS, BYTES, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
WORD = re.compile("[^\x20\x09-\x0d]+")
TURNS = "conv_id long, turn int, role string, text string, depth int, d1 long, slot string, length string, cut string"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def merges():
    return chunked_bpe.Merges.of_ranks(open(RANKS, "rb").read())


def little(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


# ---- chunked encoding ------------------------------------------------------------


@pytest.mark.parametrize("letters", ["'  \nsterlmdv1.", "aeioustrnl", " \t'abcXYZéß中01.,-_=/\\😀　\x1c\x85"])
def test_words_are_merged_as_the_library_does(merges, library, letters):
    rng = random.Random(letters)
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([3, 20, 90, 700]))) for _ in range(300)]
    words = regex.compile(public_tokenizers.PATTERN)
    ids, first = merges.encode([words.findall(t) for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == [library.encode_ordinary(t) for t in texts]
    assert merges.decode(ids, first) == [t.encode() for t in texts]


def test_forgotten_words_are_learnt_again(merges, library, monkeypatch):
    monkeypatch.setattr(chunked_bpe, "REMEMBERED", 3)
    for text in ("one two three", "four five one", "one six", "seven eight nine ten one"):
        ids, _ = merges.encode([regex.findall(public_tokenizers.PATTERN, text)])
        assert ids.tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize(("chunk", "overlap"), [(16_384, 512), (100, 20), (23, 8)])
def test_chunked_texts_are_the_library_s(docs, rows, library, chunk, overlap):
    # Twice the rows: repeated long texts, in one and in several chunks.
    got = chunked_bpe.encode_and_decode(docs.union(docs), RANKS, public_tokenizers.PATTERN, chunk, overlap).collect()
    want = collections.Counter()
    for i, t in rows:
        want[i, little(library.encode_ordinary(t)), t.encode()] += 2
    assert collections.Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == want


def test_chunks_agree_from_a_common_boundary_on():
    words = regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(4)
    agreed = 0
    for _ in range(500):
        text = "".join(rng.choice("ab  'sre\n1.") for _ in range(200))
        chunk, overlap, reach = 80, 30, 3
        left, right = text[:chunk], text[chunk - overlap :]
        tails = {b for b in chunked_bpe.boundaries(words, left) if chunk - overlap <= b <= chunk - reach}
        both = tails & {b + chunk - overlap for b in [0, *chunked_bpe.boundaries(words, right)]}
        for at in both:
            agreed += 1
            assert chunked_bpe.within(words, left, at) + words.findall(text[at:]) == words.findall(text)
    assert agreed > 500


def test_seams_in_white_space_and_contractions(spark, library):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["\n", " ", "'", "re", "'ll", "x", "\t", "7"]) for _ in range(400)) for _ in range(200)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.ids) for r in chunked_bpe.encode_and_decode(table, RANKS, public_tokenizers.PATTERN, 60, 20).collect()}
    assert got == {i: little(library.encode_ordinary(t)) for i, t in enumerate(texts)}


def test_chunks_must_be_longer_than_overlaps(docs):
    with pytest.raises(ValueError):
        chunked_bpe.encode_and_decode(docs, RANKS, public_tokenizers.PATTERN, 20, 15)


def test_no_documents_no_tokens(nothing):
    assert chunked_bpe.encode_and_decode(nothing, RANKS, public_tokenizers.PATTERN).collect() == []


# ---- prefix trie -----------------------------------------------------------------


def turns_of(case: str) -> list[tuple]:
    rng = random.Random(case)
    if case == "odd":
        given = [
            (0, 1, "user", "Hello there"), (0, 2, None, "a  b\nc"), (0, 3, "user", None), (0, None, "system", "first of all"),
            (20, 1, "user", "x"), (20, 1, "user", "x"), (20, 1, "user", "x"), (20, 5, "", ""), (39, -4, None, None), (39, 0, "", ""), (61, 3, "u", "own only"),
            (-7, 2, "user", "below zero"), (-7, 3, "user", "c d"), (-20, 1, "user", "twenty below"), (-33, 1, "ab", "c"), (-33, 2, "a", "bc"),
            (None, 1, "user", "nobody's"), (None, 2, "user", "nobody's"), (1, 1, "user", "one"), (2, 2**31 - 1, "user", "two \x85 words"), (2, -(2**31), "u", "t"),
        ]
        return given
    if case == "copies":  # many equal conversations, and some that end inside others
        return [(i, k, "user", f"turn {k}") for i in range(300) for k in range(2 + (i % 7 == 0) + 3 * (i % 50 == 0))]
    if case == "long":  # one conversation holds a third of all turns
        return [(5, k, "user", f"t {k % 3}") for k in range(700)] + [(i, k, "user", rng.choice("ab")) for i in range(300) for k in range(5)]
    return [(rng.randrange(60), rng.randrange(9), rng.choice(["user", "bot"]), rng.choice(["a", "b c", "d e f"])) for _ in range(400)]


def plain_trie(rows: list[tuple], order) -> collections.Counter:
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x, key=order)] for c, x in own.items()}
    whole = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(int(c / 20) * 20, [])[:h] + x[h:]
    members = collections.defaultdict(list)
    for c, x in whole.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    kids, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        worth = (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += worth
            leaves[p[:d]] += not kids[p]
    out = collections.Counter()
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p))))
        up = min(members[p[:-1]]) if p else None
        out[min(m), len(p), up, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("case", ["odd", "copies", "long", "random"])
@pytest.mark.parametrize("bound", [4096, 4])
def test_trie_is_the_plain_one(spark, case, bound, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SUBTREE", bound)
    monkeypatch.setattr(prefix_trie, "WIDER", 16 if bound < 4096 else 4096)
    monkeypatch.setattr(prefix_trie, "STRETCH", 8)
    rows = turns_of(case)
    if case == "random":  # equal turn numbers: their order is the operator's own
        rows = sorted({r[:2]: r for r in rows}.values())
    table = spark.createDataFrame([(*r, 9, 9, "s", "l", "c") for r in rows], TURNS)
    got = collections.Counter(map(tuple, prefix_trie.shared_prefix_trie(table).collect()))
    assert got == plain_trie(rows, lambda t: t)


def test_equal_turn_numbers_have_one_order(spark):
    rows = [(c, 1, "user", t) for c in (0, 20, 40) for t in ("a", "b", "c")]
    for given in (rows, rows[::-1]):
        nodes = prefix_trie.shared_prefix_trie(spark.createDataFrame([(*r, 9, 9, "s", "l", "c") for r in given], TURNS)).collect()
        assert max(n.n_convs for n in nodes if n.depth == 0) == 3 and len({n.depth for n in nodes}) == 4


def test_no_conversations_no_nodes(spark):
    assert prefix_trie.shared_prefix_trie(spark.createDataFrame([], TURNS)).collect() == []


def test_two_prefixes_of_one_digest_are_refused(spark):
    columns = "conv_id long, depth int, d1 long, d2 long, a long, b long, words long, length long"
    paths = spark.createDataFrame([(1, 1, 5, 6, 10, 11, 2, 1), (2, 1, 5, 6, 12, 13, 2, 1)], columns)
    with pytest.raises(Exception, match="one digest"):
        prefix_trie.nodes_of(paths).collect()


def test_slots_are_minimal_perfect_and_checked():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 5000):
        d1, d2 = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
        slots = prefix_trie.Slots(d1, d2)
        assert sorted(slots.find(d1, d2).tolist()) == list(range(n))
        assert (slots.find(d1, d2 + np.uint64(1)) == -1).all()


def test_equal_keys_of_different_digests_get_their_own_slots():
    from kerbline.llm.arrays import mix

    d1 = np.array([1, 2], np.uint64)
    d2 = mix(d1.copy())  # both keys are zero under the first salt
    assert sorted(prefix_trie.Slots(d1, d2).find(d1, d2).tolist()) == [0, 1]


# ---- alignment -------------------------------------------------------------------


def plain_alignment(rows: list[tuple]) -> list[tuple]:
    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    letters = align.byte_letters()
    pairs, out = collections.Counter(), []
    for i, text in rows:
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        sa = [bytes(letters[c] for c in a.id_to_token(x)) for x in ia]
        sb = [bytes([int(p[3:5], 16)]) if b.is_byte(x) else p.replace("▁", " ").encode() for x, p in ((x, b.id_to_piece(x)) for x in ib)]
        if not text or b"".join(sa) != (" " + text).encode() or b"".join(sb) != (" " + text).encode():
            out.append((i, [], [], [], 0, ""))
            continue
        ea, eb = np.cumsum([len(x) for x in sa]).tolist(), np.cumsum([len(x) for x in sb]).tolist()
        links = [(x, y) for x in range(len(ia)) for y in range(len(ib)) if max(ea[x] - len(sa[x]), eb[y] - len(sb[y])) < min(ea[x], eb[y])] if len(ia) < 400 else walked(ea, eb)
        cuts = sorted(set(ea) & set(eb))
        groups = [([], []) for _ in cuts]
        for side, (ids, ends) in enumerate(((ia, ea), (ib, eb))):
            for x, e in zip(ids, ends, strict=True):
                groups[np.searchsorted(cuts, e)][side].append(x)
        named = [(ia[x], ib[y]) for x, y in links]
        pairs.update(named)
        out.append((i, ia, ib, named, len(cuts), ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)))
    best = collections.Counter()
    for (_, y), n in pairs.items():
        best[y] = max(best[y], n)
    return [(i, len(x), len(y), g, len(n), sum(pairs[p] == best[p[1]] for p in n), sum(pairs[p] for p in n), t) for i, x, y, n, g, t in out]


def walked(ea: list[int], eb: list[int]) -> list[tuple[int, int]]:
    """Overlapping tokens by their ends, one pair after the other."""
    out, i, j = [], 0, 0
    while i < len(ea) and j < len(eb):
        out.append((i, j))
        i, j = i + (ea[i] <= eb[j]), j + (eb[j] <= ea[i])
    return out


@pytest.mark.parametrize("links", [4_000_000, 300])
def test_alignment_is_the_plain_one(spark, docs, rows, links, monkeypatch):
    monkeypatch.setattr(align, "BLOCK_LINKS", links)
    more = [(2000, "a▁b"), (2001, "<s>x</s> <unk> <0x0A>"), (2002, " lead and trail "), (2003, "ﬁ ① ﻿   ́"), (2004, "\x00"), (2004, "\x00"), (2005, " ")]
    given = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    for hashed in (False, True):
        got = align.alignment(given, BYTES, PIECES, public_tokenizers.PATTERN, hashed).collect()
        want = collections.Counter(x if not hashed or not x[7] else (*x[:7], hashlib.sha256(x[7].encode()).hexdigest()) for x in plain_alignment(rows + more))
        assert collections.Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got) == want


@pytest.mark.parametrize("lane", [1, 3, 1000])
def test_lanes_do_not_change_the_links(lane):
    rng = np.random.default_rng(lane)
    for _ in range(50):
        sides = []
        total = rng.integers(0, 40, 4)
        for _ in range(2):
            ends = [np.union1d(rng.integers(1, n + 1, n // 3), [n]) if n else np.zeros(0, int) for n in total]
            first = np.append(0, np.cumsum([len(e) for e in ends]))
            sides.append(align.Side(np.zeros(first[-1], np.int64), first, np.concatenate([e + s for e, s in zip(ends, np.cumsum(total) - total, strict=True)]).astype(np.int64)))
        left, right, cut = align.links_of(*sides, lane)
        want = walked(sides[0].end.tolist(), sides[1].end.tolist())
        assert list(zip(left.tolist(), right.tolist(), strict=True)) == want
        assert cut.tolist() == [sides[0].end[i] == sides[1].end[j] for i, j in want]


def test_nothing_to_align(nothing):
    assert align.alignment(nothing, BYTES, PIECES, public_tokenizers.PATTERN).collect() == []
