"""Word encoder, Arrow id files, packing and SentencePiece against the libraries and by round trip."""

import random
import zlib
from collections import defaultdict

import edge
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loadcast.llm import idfiles, packing, pieces, tokens

TEXTS = [r[1] or "" for r in edge.documents()] + [
    " ", "  ", "a  b", " a", "a ", "a\n b", "a \n b", "it's we'll\t x", "é́ x ́y", "<|endoftext|> x<|endoftext|>y",
    "x　y z", "ΑΣ ΣΑΣ, ΟΔΟΣ", "中文 测试 12 345", "\x85 a", "a​ b", "\n\n x", "a 's 't", "İstanbul DIŞ", "▁▁ x",
    "     x     y", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "======== ........ --------", "\x01\x02 a\x00b"]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_encoder_is_the_library(name, spaced):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    encoder = tokens.WordEncoder(path, spaced)
    for texts in (TEXTS, TEXTS[::-1], [], [""]):
        ids, n = encoder.encode([t.encode() for t in texts])
        cuts = np.cumsum(n)
        assert [ids[c - k : c].tolist() for c, k in zip(cuts, n)] == [
            plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_encoder_in_parts_and_with_a_short_memory(name, spaced, monkeypatch):
    monkeypatch.setattr(tokens, "PART_BYTES", 300)
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    monkeypatch.setattr(tokens, "CALL", 3)
    path = public_tokenizers.path(name)
    plain, encoder = Tokenizer.from_file(path), tokens.WordEncoder(path, spaced)
    for _ in range(3):
        for at in (0, 5):
            ids, n = encoder.encode([t.encode() for t in TEXTS[at:]])
            want = [plain.encode(t, add_special_tokens=False).ids for t in TEXTS[at:]]
            assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_distinct_words_survive_collisions(monkeypatch):
    """A multiplier of 0 gives all words one hash."""
    text = b"a bb ccc a dddddddddd dddddddddd\x00 bb dddddddddd " + b" " * 8
    data = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(data == 32, prepend=True, append=True))
    want = [text[a:b] for a, b in zip(edges[::2], edges[1::2])]
    for odd in (tokens._ODD, np.uint64(0)):
        monkeypatch.setattr(tokens, "_ODD", odd)
        codes, of = tokens.distinct_words(data, edges[::2], np.diff(edges)[::2])
        assert [want[of[c]] for c in codes] == want and len(of) == len(set(want))


def test_sentencepiece_is_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    ids, n = model.encode(TEXTS)
    cuts = np.cumsum(n)
    assert [ids[c - k : c].tolist() for c, k in zip(cuts, n)] == [library.encode(t) for t in TEXTS]
    assert [d.decode() for d in model.decode(ids, n)] == [t.replace("▁", " ") for t in TEXTS]


def test_sentencepiece_pairs_survive_a_tiny_table():
    """With few places answers overwrite each other all the time."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    pieces_before = pieces.PAIRS
    try:
        pieces.PAIRS = 8
        model.pair_key, model.pair_stands = np.full(8, -1, np.int64), np.zeros(8, bool)
        ids, _ = model.encode(TEXTS)
    finally:
        pieces.PAIRS = pieces_before
    assert ids.tolist() == [i for t in TEXTS for i in library.encode(t)]


def test_unigram_takes_the_largest_sum(tmp_path):
    """The same file read as a unigram model, against all ways to cut each word."""
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        data = f.read()
    mark = b"\x18\x02\x20\x80\xfa\x01"  # model type 2, vocabulary 32000
    assert data.count(mark) == 1
    path = tmp_path / "unigram.model"
    path.write_bytes(data.replace(mark, b"\x18\x01\x20\x80\xfa\x01"))
    model = pieces.PieceModel(str(path))
    assert model.settings.kind == pieces.UNIGRAM
    score = {t: s for t, s, kind in model.pieces if kind == pieces.NORMAL}
    lowest = model.score.min() - 10
    for text in [*TEXTS[:4], *TEXTS[12:17], "it's we'll", "morning light carries", "中文 测 😀 x"]:
        whole = "▁" + text.replace(" ", "▁") if text else ""
        best = [0.0] + [-np.inf] * len(whole)
        for end in range(1, len(whole) + 1):
            for start in range(max(0, end - 16), end):
                part = whole[start:end]
                if part in score or end - start == 1:
                    best[end] = max(best[end], best[start] + score.get(part, lowest))
        ids, n = model.encode([text])
        raw = model.decode(ids, n)[0].decode()
        assert raw == text
        byte = np.array([model.pieces[i][2] == pieces.BYTE for i in ids], bool)
        missing = sum(c not in score for c in whole)
        assert model.score[ids[~byte]].sum() + missing * lowest == pytest.approx(best[-1])


def test_encoded_rows(spark):
    rows = edge.documents()
    found = pieces.encoded(edge.frame(spark, rows), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(found) == len(rows)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r[0] if r[0] is not None else -1, crc(library.encode(r[1] or "")), r[1] or "") for r in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, zlib.crc32(r.ids), r.decoded) for r in found) == want
    assert pieces.encoded(edge.frame(spark, []), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_id_files(spark):
    rows = [r for r in edge.documents() if r[0] != 130]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    manifest = idfiles.write(edge.frame(spark, rows), path, 0, idfiles.new_folder(spark), sequence=64)
    found = {r.doc_id: r for r in idfiles.read(manifest, "bigint").collect() if r.doc_id is not None}
    start = 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for r in order:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]
        if r[0] is not None:
            assert (found[r[0]].start, found[r[0]].n_tokens, found[r[0]].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    everything = [i for r in order for i in [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]]
    at = 0
    for file in sorted(manifest.collect(), key=lambda f: f.shard):
        reader = idfiles.SequenceReader(file.path)
        for k in range(-(-file.n_tokens // 64)):
            ids, mask = reader.sequence_at(k)
            real = min(64, file.n_tokens - 64 * k)
            assert len(ids) == 64 and mask.tolist() == [True] * real + [False] * (64 - real)
            assert ids[:real].tolist() == everything[at : at + real] and not ids.flags.owndata
            at += real
    assert at == len(everything)


def test_id_files_of_nothing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = idfiles.write(edge.frame(spark, []), path, 0, idfiles.new_folder(spark))
    assert manifest.count() == 0 and idfiles.read(manifest, "bigint").count() == 0


def sequences(found, window):
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= window
    return {s: sum(n for _, n in parts) for s, parts in by.items()}


@pytest.mark.parametrize("shard,task", [(1 << 20, 1 << 23), (700, 2000)])
def test_packing_places_each_id_once(spark, shard, task):
    rows = edge.documents()
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    found = packing.packed(edge.frame(spark, rows), path, 2, window=256, shard_tokens=shard, task_tokens=task).collect()
    full = sequences(found, 256)
    tasks = len({s >> 40 for s in full})
    assert sum(n < 256 for n in full.values()) <= tasks
    docs = defaultdict(list)
    for r in found:
        docs[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append([*library.encode(r[1] or "", add_special_tokens=False).ids, 2])
    assert docs.keys() == want.keys()
    for i, texts in want.items():
        if len(texts) == 1:
            parts = sorted(docs[i])
            assert [x for _, ids, _ in parts for x in ids] == texts[0] and {t for *_, t in parts} == {len(texts[0])}
            assert [s for s, _, _ in parts] == np.cumsum([0] + [len(ids) for _, ids, _ in parts])[:-1].tolist()
        else:
            assert sum(len(ids) for _, ids, _ in docs[i]) == sum(map(len, texts))
    assert packing.packed(edge.frame(spark, []), path, 2).count() == 0


def test_neighbours_are_ranked_by_bm25():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 50, rng.integers(5, 60)) for _ in range(40)]
    df = np.array([sum(t in d for d in docs) for t in range(50)])
    idf = np.log1p((40 - df + 0.5) / (df + 0.5))
    mean = np.mean([len(d) for d in docs])
    shard = packing.Shard(docs, idf, mean)

    def weight(t, d):
        tf = (d == t).sum()
        return idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))

    for seed in (0, 7):
        terms = sorted(set(docs[seed].tolist()), key=lambda t: -weight(t, docs[seed]))[:8]
        score = {i: sum(weight(t, d) for t in terms) for i, d in enumerate(docs)}
        found = shard.neighbours(seed, 8, np.arange(40) != 3).tolist()
        assert set(found) == {i for i, s in score.items() if s > 0 and i != 3}
        assert all(score[a] >= score[b] - 1e-9 for a, b in zip(found, found[1:]))


def test_a_window_holds_the_seed_and_its_nearest():
    a, b = np.arange(10), np.arange(100, 110)
    docs = [np.tile(a, 3), np.tile(b, 3), np.tile(a, 3) + 0, np.tile(b, 3), np.arange(200, 230)]
    idf = np.ones(300)
    placed, left = packing.pack(docs, idf, 30, window=60)
    order = [p[0] for p in placed]
    assert order == [0, 2, 1, 3, 4] and left == 30


def test_related_documents_are_dealt_together(spark):
    """Documents of eight subjects: a task holds far more of a document's subject than chance would put there."""
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(4)
    subjects = [["".join(rng.choices("abcdefghijklmnoprstuvw", k=5)) for _ in range(40)] for _ in range(8)]
    rows = [edge.row(i, " ".join(rng.choices(subjects[i % 8], k=60))) for i in range(400)]
    rows += [edge.row(1000, rows[0][1])] * 100
    docs = edge.frame(spark, rows)
    table = packing.stored(packing.tokenised(docs, "doc_id", "text", path, 2, pivot=packing.pivots(docs, "text", path)).withColumn("row", F.monotonically_increasing_id()), "tokens")
    n = table.agg(F.sum("n")).first()[0]
    made = packing.dealt(table, n, n // 8 + 1).withColumn("task", F.spark_partition_id())
    sizes = dict(made.groupBy("task").agg(F.sum(F.length("ids") / 2)).collect())
    assert len(sizes) == 8 and sum(sizes.values()) == n and max(sizes.values()) <= 1.5 * n / 8
    tasks = defaultdict(list)
    for r in made.where("doc_id < 1000").collect():
        tasks[r.task].append(r.doc_id % 8)
    together = sum(t.count(x) ** 2 for t in tasks.values() for x in range(8)) / 400 / 50
    assert together > 0.4  # chance is 0.125


def test_routes_of_nothing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    for rows in ([], [edge.row(1, None)], [edge.row(1, ""), edge.row(1, "")]):
        assert not packing.pivots(edge.frame(spark, rows), "text", path).any()


def test_pivots_are_fitted_on_all_documents(spark):
    """Each pivot is the mean of its documents, all of them, however the table is partitioned."""
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(5)
    subjects = [["".join(rng.choices("abcdefghijklmnoprstuvw", k=5)) for _ in range(30)] for _ in range(20)]
    rows = [edge.row(i, " ".join(rng.choices(subjects[i % 20], k=8))) for i in range(3000)]
    found = packing.pivots(edge.frame(spark, rows).repartition(3), "text", path)
    again = packing.pivots(edge.frame(spark, rows).repartition(7, "doc_id"), "text", path)
    assert np.array_equal(found, again)
    library = Tokenizer.from_file(path)
    held = [np.array(sorted({*library.encode(r[1], add_special_tokens=False).ids})) for r in rows]
    # no id is left out: each adds something to some pivot
    assert found[np.unique(np.concatenate(held))].any(1).all()


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_across_lines_and_of_many_letters(name, spaced):
    path, rng = public_tokenizers.path(name), random.Random(3)
    signs = ["a", "the", "Bär", "É", "ǅ", "ɐ", "İ", "ß", "Σ", "Ж", "中", "7", "ª", "²", ".", "'s", "...", "\n", "\n\n", "\n\n\n",
             "\r", "\t", "\xa0", "　", " ", " ", "  ", "\x85", "é"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(3000)]
    plain, encoder = Tokenizer.from_file(path), tokens.WordEncoder(path, spaced)
    ids, n = encoder.encode([t.encode() for t in texts])
    for t, found in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
        assert found.tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_words_of_letters_go_to_the_model_alone():
    """The way through normalising and splitting is for other words, and lines are no reason to take it."""
    encoder = tokens.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    seen = []
    whole = encoder._whole
    encoder._whole = lambda texts: seen.extend(texts) or whole(texts)
    encoder.encode([("x " + "one twö.\n\nthree, föur\nfive six-seven " * 3).strip().encode()])
    assert set(seen) <= {"x", "\n", "", ".", ",", " six-seven"}


def test_words_seen_lately_are_not_encoded_again(monkeypatch):
    """Far more words than a batch has are known, and when they are too many, the ones in use stay."""
    monkeypatch.setattr(tokens, "REMEMBERED", 2000)
    rng, made = random.Random(6), []
    words = [w.encode() for w in {"".join(rng.choices("abcdeäß中'.\x00", k=rng.randrange(1, 15))) for _ in range(2000)}]
    kept, memory = words[:50], tokens.Memory()
    for at in (50, 50, 400, 800, 1200, 1600, 1600):
        part = kept + words[at : at + 300]
        _, data, begin = tokens.joined(part)

        def encode(which):
            made.append([part[i] for i in which.tolist()])
            return (np.array([b for w in made[-1] for b in w], np.int64), np.array([len(w) for w in made[-1]], np.int64))

        ids, n = memory.ids_of(data, begin, np.array(list(map(len, part))), encode)
        assert ids.tolist() == [b for w in part for b in w] and n.tolist() == list(map(len, part))
    short = [[w for w in m if len(w) <= tokens.SHORT] for m in made]
    assert len(memory.starts) <= 2000 and not short[1] and not short[6]
    assert not {w for m in short[1:] for w in m} & set(kept)
    monkeypatch.setattr(tokens, "REMEMBERED", 1 << 20)
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    seen, whole = [], model.encode_words
    model.encode_words = lambda words: seen.append(len(words)) or whole(words)
    for _ in range(2):
        ids, n = model.encode([t.encode().decode() for t in TEXTS])
        assert ids.tolist() == [i for t in TEXTS for i in library.encode(t)]
    assert seen[1] < seen[0] / 2
