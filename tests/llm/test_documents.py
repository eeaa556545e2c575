"""Document operators against brute force: edge rows, empty tables, clashing columns, whole small tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pitwise.llm import golomb, mixing, rans, sentencepiece_spans, shard, simhash, substring
from pitwise.llm.queries import vocabulary
from tests.llm.brute import WORD, components, repeats, simhash as brute_simhash

SPACES = {c: None for c in (32, 9, 10, 11, 12, 13)}


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# --- sharding ---

def jump(key, n):
    """The published loop."""
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * shard.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_by_key(spark):
    ids = [0, 1, -1, 2**63 - 1, -2**63, 123456789, None, *range(300)]
    df = spark.createDataFrame([(i, "t", 1) for i in ids], "doc_id long, Shard string, state int")
    got = shard.assign_shards(df.drop("Shard"), 40).collect()
    assert Counter((r.doc_id, r.shard, r.grown_shard) for r in got) == Counter((i, jump(i or 0, 40), jump(i or 0, 41)) for i in ids)
    assert all(r.grown_shard in (r.shard, 40) for r in got)


def test_manifest(edge_docs, no_docs):
    got = shard.shard_manifest(edge_docs, 5).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in pairs(edge_docs))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard.shard_manifest(no_docs, 5).count() == 0


# --- mixing ---

def test_mixing(edge_docs, no_docs, small_docs):
    for docs in (edge_docs, small_docs):
        got = mixing.mix(docs).collect()
        assert len(got) == docs.count()
        by = defaultdict(list)
        for r in got:
            assert r["size"] == len(WORD.findall(r.text or "")) and 0 <= r.copies <= 3
            by[r.source].append(r)
        names = sorted(by, key=lambda s: (s is None, s))
        sizes = {s: sum(r["size"] for r in by[s]) for s in names}
        weight = {s: i % 3 + 1 for i, s in enumerate(names)}
        full, total = set(), sum(sizes.values())
        while True:                                            # clamp and reshare
            left, share = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
            over = {s for s in names if s not in full and left * weight[s] > 3 * sizes[s] * share}
            if not over:
                break
            full |= over
        for s in names:
            target = 3 * sizes[s] if s in full else left * weight[s] / share
            assert by[s][0].target == pytest.approx(target)
            assert abs(sum(r["size"] * r.copies for r in by[s]) - target) <= max(r["size"] for r in by[s]) / 2 + 1e-6
        again = mixing.mix(docs).collect()
        assert Counter((r.doc_id, r.copies) for r in got) == Counter((r.doc_id, r.copies) for r in again)
        assert mixing.take(docs).count() == sum(r.copies for r in got)
    assert mixing.mix(no_docs).count() == 0


# --- exact dedup ---

def test_golomb_code():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, np.uint64), np.array([0, 2**58], np.uint64), np.unique(rng.integers(0, 2**58, 5000, dtype=np.uint64))):
        rice = golomb.rice_parameter(58, len(values))
        assert (golomb.golomb_decode(golomb.golomb_encode(values, rice), len(values), rice) == values).all()


def test_exact_duplicates(edge_docs, no_docs):
    rows = pairs(edge_docs)
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(SPACES)].append((-len(t or ""), i is None, i))
    got = golomb.exact_duplicates(edge_docs)
    by = defaultdict(list)
    for r in got.collect():
        by[r.text_sha256].append(r)
    assert len(by) == len(groups) and sum(map(len, by.values())) == len(rows)
    for text, members in groups.items():
        found, best = by[hashlib.sha256(text.encode()).hexdigest()], min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        assert sorted(str(r.doc_id) for r in found) == sorted(str(m[2]) for m in members)
        assert {r.group_size for r in found} == {len(members)} and {r.keep_id for r in found} == {best[2]}
        assert sum(r.kept for r in found) == 1
    kept = golomb.deduplicate(edge_docs)
    assert kept.columns == edge_docs.columns
    assert Counter((t or "").translate(SPACES) for _, t in pairs(kept)) == Counter(dict.fromkeys(groups, 1))
    assert golomb.exact_duplicates(no_docs).count() == 0 and golomb.deduplicate(no_docs).count() == 0


# --- SimHash ---

@pytest.mark.parametrize("most", [simhash.BUCKET, 1])
def test_simhash(spark, edge_docs, small_docs, most):
    base = " ".join(f"v{i}" for i in range(400))
    near = [base + (f" t{i}" if i % 2 else "") + f" u{i // 4}" for i in range(60)]        # a chain of close texts
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(near)], "doc_id long, text string")
    docs = edge_docs.select("doc_id", "text").unionByName(more).unionByName(small_docs.selectExpr("doc_id + 2000 as doc_id", "text"))
    rows = pairs(docs)
    fps = [brute_simhash(t) for _, t in rows]
    distinct = sorted(set(fps))
    comp = components(distinct, [(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1:] if (a ^ b).bit_count() <= 2])
    least = defaultdict(lambda: None)
    for (i, _), fp in zip(rows, fps):
        if i is not None:
            least[comp[fp]] = i if least[comp[fp]] is None else min(i, least[comp[fp]])
    got = Counter((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in simhash.near_duplicates(docs, most=most).collect())
    assert got == Counter((i, fp, least[comp[fp]]) for (i, _), fp in zip(rows, fps))
    kept = pairs(simhash.deduplicate(docs, most=most))
    assert len(kept) == len(set(comp.values()))
    assert {i for i, _ in kept if i is not None} == {i for i in least.values() if i is not None}


def test_simhash_large_group(spark):
    """A group beyond what one place pairs up: a forest, split buckets, the same classes."""
    fps = np.unique(np.random.default_rng(3).integers(0, 2**9, 400)).astype(np.uint64) << np.uint64(20)
    rows = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    comp = components([int(x) for x in fps], [(int(a), int(b)) for k, a in enumerate(fps) for b in fps[k + 1:] if (int(a) ^ int(b)).bit_count() <= 2])
    for most in (simhash.BUCKET, 16):
        keys = simhash.candidate_keys(rows, most)
        met = keys.repartition(3, "mask", "shared").sortWithinPartitions("mask", "shared", "fp")
        got = {r.node: r.component for r in simhash.connected_components(met.mapInArrow(simhash._links, "u long, v long")).collect()}
        assert {n: got.get(n, n) for n in comp} == comp


def test_simhash_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.deduplicate(no_docs).count() == 0


# --- substring dedup ---

@pytest.mark.parametrize("size", [35, 9])
def test_repeats(edge_docs, no_docs, small_docs, size):
    for docs in (edge_docs, small_docs):
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs, size=size).collect())
        want = Counter((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)) for i, w, gone in repeats(pairs(docs), size))
        assert got == want
    spans = substring.maximal_repeats(small_docs, size=size).collect()
    covered = defaultdict(set)
    for r in spans:
        assert r.n_words >= size
        covered[r.doc_id].update(range(r.first_word, r.first_word + r.n_words))
    assert all(covered[i] == gone for i, _, gone in repeats(pairs(small_docs), size))
    assert substring.remove_repeats(no_docs).count() == 0 and substring.maximal_repeats(no_docs).count() == 0


# --- token files ---

def test_token_files(edge_docs, no_docs):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    files = rans.write_token_files(edge_docs, rans.scratch_path(edge_docs, "t"), path, 2)
    got = rans.read_ids(files).collect()
    want = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in pairs(edge_docs)]
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(x)) for i, x in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert rans.read_digests(rans.write_token_files(no_docs, rans.scratch_path(no_docs, "t"), path, 2)).count() == 0


def test_rans_blocks():
    rng = np.random.default_rng(2)
    for n in (1, 7, 2048, 2049, 400_000):
        ids = np.minimum(rng.geometric(0.01, n), 3000).astype(np.uint32)
        table = rans.Table(rans.scaled_frequencies(np.bincount(ids, minlength=3001)))
        coded = rans.encode_block(ids, table)
        assert (rans.decode_block(n, *coded, table) == ids).all()
        wide = rans.LANES * rans.STEPS
        for part in range(-(-n // wide)):
            assert (rans.decode_block(n, *coded, table, first=part, stop=part + 1) == ids[part * wide:(part + 1) * wide]).all()


def test_words_apart():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tokenizer, rng = Tokenizer.from_file(path), np.random.default_rng(4)
    texts = ["Don't. É! İ! x́. <|endoftext|> <|ENDOFTEXT|>. ªº. a.b ..x. ǅ. \x1cfoo\x1d x\x85y"] + [
        "".join(rng.choice(list("aBÉ.,é'!́ x1<|>’日İ "), 30)) for _ in range(2000)]
    ids, first = rans.token_ids(pa.array(texts), path, rans.words_apart(path))
    assert rans.words_apart(path) and not rans.words_apart(vocabulary("byte_bpe_50k.json"))
    for k, t in enumerate(texts):
        assert ids[first[k]:first[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


# --- SentencePiece ---

def test_sentencepiece(edge_docs, no_docs):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in sentencepiece_spans.encode(edge_docs, path).collect():
        raw = (r.text or "").encode()
        assert r.ids == own.encode(r.text or "", add_bos=True, add_eos=True)
        assert b"".join(raw[a:b] for a, b in zip(r.span_begin, r.span_end)) == raw
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentencepiece_spans.digests(edge_docs, path).collect())
    want = Counter()
    for i, t in pairs(edge_docs):
        ids = own.encode(t or "", add_bos=True, add_eos=True)
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
              hashlib.sha256(own.decode(ids).encode()).hexdigest())] += 1
    assert got == want
    assert sentencepiece_spans.digests(no_docs, path).count() == 0


def test_character_map():
    """A hand-made double array: 'a' -> 'x', 'ab' -> '', and user-defined symbols."""
    trie = np.zeros(1024, np.uint32)
    # root's children sit at root offset ^ byte; a leaf child at offset ^ 0 holds the value
    root, first, second = 256, 512, 768
    trie[0] = root << 10
    trie[root ^ ord("a")] = (first ^ root ^ ord("a")) << 10 | 1 << 8 | ord("a")
    trie[first] = 1 << 31 | 0
    trie[first ^ ord("b")] = (second ^ first ^ ord("b")) << 10 | 1 << 8 | ord("b")
    trie[second] = 1 << 31 | 2
    rules = sentencepiece_spans.Rules(trie, b"x\0\0", True, True, True, False, ("aab".encode(),))
    text = "  a ab  aab b  ".encode()
    out, bounds, source = sentencepiece_spans.normalise(rules, np.frombuffer(text + b"\0", np.uint8), np.array([0, len(text)]))
    assert out.tobytes().decode() == "▁x▁aab▁b" and bounds.tolist() == [0, len(out)]
    assert text[source[3]:source[3] + 1] == b"a" and text[source[7]:source[7] + 3] == b"aab"
