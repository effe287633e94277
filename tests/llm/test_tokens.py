import random
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuslab.llm import packing, scratch, token_files, tokens

ODD = ["a  b", "a   b", " a", "  a", "a ", "a\n ", "\n \nfoo", "x \t y", "\t\n \r\n", "a<|endoftext|>b", "x <|endoftext|> y", "\n <|endoftext|>", "don't I'LL", "é　è \xa0 z", "😀 12,345 x", "a \n b \n  c"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_vocabulary())


def encoded(enc, texts):
    return [ids[a:b].tolist() for _, _, ids, where in enc.encode(texts) for a, b in zip(where.tolist(), where[1:].tolist(), strict=False)]


def test_cache_equals_library(library, hard_texts):
    rng = random.Random(1)
    mixed = ["".join(rng.choice(["a", "bc", " ", " ", "\n", "\t", ",", "1", "é", "'s", "\x1c", "\x85", "\xa0", "　", "×", "’", "'", "日", "\u0301", "longerthanfifteenbytes"]) for _ in range(30)) for _ in range(3000)]
    texts = [*hard_texts, *ODD, *mixed]
    enc = tokens.Encoder(tokens.default_vocabulary())
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert encoded(enc, texts) == want
    assert 0 < enc.table.count <= tokens.UNITS


@pytest.mark.parametrize("units", [1, 7, 100])
def test_table_smaller_than_its_texts(library, hard_texts, units, monkeypatch):
    monkeypatch.setattr(tokens, "UNITS", units)
    monkeypatch.setattr(tokens, "CHUNK", 500)
    enc = tokens.Encoder(tokens.default_vocabulary())
    texts = [*hard_texts, *ODD, *hard_texts]
    assert encoded(enc, texts) == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert enc.table.count <= units


def test_new_units_share_calls(library, monkeypatch):
    class Counted:
        texts = 0

        def encode_batch_fast(self, texts, **options):
            self.texts += len(texts)
            return library.encode_batch_fast(texts, **options)

    rng = random.Random(3)
    enc, counted = tokens.Encoder(tokens.default_vocabulary()), Counted()
    monkeypatch.setattr(enc, "tokenizer", counted)
    text = "".join(" " + "".join(rng.choice("aeiourstln") for _ in range(9)) for _ in range(5000))
    assert encoded(enc, [text]) == [library.encode(text, add_special_tokens=False).ids]
    assert enc.table.count > 4900 and counted.texts < 500


def test_units_in_one_call_equal_units_alone(library):
    enc, rng = tokens.Encoder(tokens.default_vocabulary()), random.Random(4)
    pieces = ["<|", "endoftext", "|>", "<|endoftext|>", " x<|endoftext|>", "'", "'s", "s", " a", "a", "  ", " ", "\n", "\n b", "é", " é", "日", "\xa0", "1", "12 ", " longerthanfifteenbytes", "×"]
    units = [b"<|", b"endoftext", b"|>", *(rng.choice(pieces).encode() for _ in range(4000))]
    for some in (units, [*units, b" a\xff", b" b", b"\xf0\x90\x80", b" c"]):  # the last are no UTF-8
        ids, n = enc._library(np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)]))
        want = [library.encode(u.decode("utf-8", "replace"), add_special_tokens=False).ids for u in some]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_words_encoded_alone_for_another_tokenizer():
    path = tokens.default_vocabulary().replace("byte_bpe_50k", "word_bpe_49k")
    enc, library = tokens.Encoder(path), Tokenizer.from_file(path)
    assert not enc.cuttable and encoded(enc, ["Two words", None, "x"]) == [library.encode(t, add_special_tokens=False).ids for t in ("Two words", "", "x")]


def test_packing_round_trip(spark, library, hard_texts):
    docs = table(spark, hard_texts * 6).repartition(5)
    rows = packing.pack(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in enumerate(hard_texts * 6):
        parts = sorted(by_doc[i], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in parts), "<u4").tolist()
        assert ids == [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert {r.doc_tokens for r in parts} == {len(ids)}
        assert [r.start for r in parts] == list(np.cumsum([0, *[r.length for r in parts]])[:-1])
    padding = 0
    for held in by_sequence.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == list(np.cumsum([0, *[r.length for r in held]])[:-1])
        fill = sum(r.length for r in held)
        assert fill <= 1024 and {r.sequence_length for r in held} == {packing.padded(fill, 1024)}
        padding += held[0].sequence_length - fill
    assert padding <= 0.02 * sum(r.length for r in rows) + 1024
    assert packing.pack(table(spark, [])).count() == 0


def test_cuts_are_reciprocals():
    for capacity in (1, 2, 7, 64, 1000, 1024):
        for rest, sizes in enumerate(packing.cuts(capacity)):
            assert sum(sizes) == rest and all(capacity // (capacity // s) == s for s in sizes)


def test_token_files_round_trip(spark, library, hard_texts):
    texts = hard_texts * 4
    at = scratch.path(spark, "t")
    token_files.write(table(spark, texts).repartition(3), at, block_tokens=3000, partitions=3)
    got = sorted(token_files.documents(spark, at).collect())
    start = 0
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    for row in spark.read.parquet(at).orderBy("part", "block").limit(4).collect():
        block = token_files.Block(row.asDict())
        every = block.ids()
        rng = random.Random(2)
        for _ in range(40):
            a = rng.randrange(len(every))
            b = rng.randrange(a, len(every)) + 1
            assert (block.slice(a, b) == every[a:b]).all()


def test_repair_compresses_and_keeps_document_ends():
    rng = np.random.default_rng(5)
    ids = np.concatenate([np.tile(rng.integers(0, 50, 40), 30), np.zeros(500, np.int64), rng.integers(0, 50, 200)]).astype(np.uint32)
    ends = np.zeros(len(ids), dtype=bool)
    ends[[99, 100, 1250, len(ids) - 1]] = True
    symbols, rules, last = token_files.compress(ids, ends, 50, min_count=2)
    grammar = token_files.Grammar(rules, token_files.rule_lengths(rules, 50), 50)
    assert (grammar.expand(symbols) == ids).all() and len(symbols) < len(ids) / 2
    assert (np.cumsum(grammar.symbol_lengths(symbols))[last] - 1).tolist() == np.flatnonzero(ends).tolist()


def test_repair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(6)
    passage = rng.integers(0, 50, 700)
    ids = np.concatenate([np.append(passage, rng.integers(0, 50, 5)) for _ in range(64)]).astype(np.uint32)
    ends = np.zeros(len(ids), dtype=bool)
    ends[704::705] = True
    symbols, rules, last = token_files.compress(ids, ends, 50)
    lengths = token_files.rule_lengths(rules, 50)
    assert lengths.max() >= 700  # the whole passage is one symbol
    free = [(a, b) for a, b, end in zip(symbols.tolist(), symbols[1:].tolist(), last.tolist(), strict=False) if not end]
    assert max(free.count(p) for p in set(free)) < token_files.MIN_COUNT


def test_repair_sets_all_scarce_self_overlaps_aside_at_once(monkeypatch):
    # Each symbol's pair with itself stands 16 times and can be replaced 8 times.
    ids = np.concatenate([np.append(np.repeat(s, 3), 200 + (k * 120 + s) % 997) for k in range(8) for s in range(120)]).astype(np.uint32)
    ends = np.arange(len(ids)) == len(ids) - 1
    rounds, bucket = [], token_files._bucket
    monkeypatch.setattr(token_files, "_bucket", lambda code, bits: rounds.append(len(code)) or bucket(code, bits))
    symbols, rules, _ = token_files.compress(ids, ends, 2000)
    assert (symbols == ids).all() and not len(rules) and len(rounds) < 10
    run = np.append(np.zeros(24, np.uint32), ids)  # 12 times without overlap
    symbols, rules, _ = token_files.compress(run, np.append(np.zeros(24, bool), ends), 2000)
    assert rules.tolist() == [[0, 0]] and symbols[:12].tolist() == [2000] * 12


def test_null_and_repeated_ids(spark):
    least = -(1 << 63)
    rows = spark.createDataFrame([(None, "a"), (least, "b"), (5, "c d"), (5, "c d"), (None, None)], "doc_id long, text string")
    at = scratch.path(spark, "t")
    token_files.write(rows, at, partitions=2)
    got = token_files.documents(spark, at).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(["None", "None", str(least), "5", "5"])
    assert sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got) and len({r.start for r in got}) == 5
    packed = packing.pack(rows).collect()
    assert sorted(str(r.doc_id) for r in packed) == sorted(["None", "None", str(least), "5", "5"])


def test_token_files_of_nothing(spark):
    at = scratch.path(spark, "t")
    token_files.write(table(spark, []), at)
    assert token_files.documents(spark, at).count() == 0


def test_packing_gets_batches_bounded_in_bytes(spark, monkeypatch):
    met, first = spark.sparkContext.accumulator(0), packing._first_round

    def watched(*args):
        run = first(*args)

        def tell(frame):
            met.add(1)
            return frame

        return lambda frames: run(map(tell, frames))

    monkeypatch.setattr(packing, "_first_round", watched)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    try:
        docs = spark.range(0, 100, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some word "), 10_000).alias("text"))
        assert packing.pack(docs, with_ids=False).agg(F.sum("length")).first()[0] == 100 * (2 * 10_000 + 2)
    finally:
        spark.conf.set(key, held)
    assert met.value >= 4  # 10 MB; by rows alone this is one batch


MEMORY = """
import random, re
import pyarrow as pa
from corpuslab.llm import tokens

def mb():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

rng = random.Random(3)
texts = pa.array([" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(1000)) for _ in range(700)])
enc = tokens.encoder(tokens.default_vocabulary())
before = mb()
print(max(mb() for _ in enc.encode(texts)) - before)
"""


def test_a_worker_encodes_in_little_memory():
    """Of new units only, MB over the loaded vocabulary: 84 were measured, and 214 with 2 MB of text at a time."""
    out = subprocess.run([sys.executable, "-c", MEMORY], capture_output=True, text=True, check=True, timeout=120)
    assert float(out.stdout) < 140
