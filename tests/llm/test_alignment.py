import hashlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from reelhouse.llm import alignment
from tests.llm.helpers import ODD as EDGES
from tests.llm.helpers import documents, random_texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def token_bytes():
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in plain}
    char |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return (tok, lambda i: bytes(char[c] for c in tok.id_to_token(i)), sp,
            lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i)
            else sp.id_to_piece(i).replace("▁", " ").encode())


def brute(rows):
    """Token by token, pairs counted in a dictionary."""
    tok, bytes_a, sp, bytes_b = token_bytes()
    found = []
    for doc_id, text in rows:
        groups = []
        if text:
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            want = (" " + text).encode()
            if b"".join(map(bytes_a, a)) == want and b"".join(map(bytes_b, b)) == want:
                end_a = end_b = i = j = 0
                own_a, own_b = [], []
                while i < len(a) or j < len(b):
                    if end_a <= end_b:
                        own_a.append(a[i])
                        end_a += len(bytes_a(a[i]))
                        i += 1
                    else:
                        own_b.append(b[j])
                        end_b += len(bytes_b(b[j]))
                        j += 1
                    if end_a == end_b:
                        groups.append((own_a, own_b))
                        own_a, own_b = [], []
        found.append((doc_id, groups))
    count = Counter((a[-1], b[-1]) for _, groups in found for a, b in groups)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for doc_id, groups in found:
        links = [(a[-1], b[-1]) for a, b in groups]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def same(rows):
    return sorted(map(str, rows))


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["", None, " ", "  two  spaces ", "a\n\nb\tc", "x\x00y", "a▁b", "<|endoftext|> <s> </s> <unk> <0x41>",
       "naïve 日本 \U0001f600 é", "don't we'll", "9" * 300, "aaaa" * 200, "ﬁx", " ​", "Hello, world! " * 50]


def table(spark, rows):
    return documents(spark, [(i, t, "s") for i, t in rows])


def test_given_texts(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = given.select("doc_id", "text").collect()
    got = alignment.align(given, A, B).collect()
    assert got[0].asDict().keys() == set(COLUMNS)
    assert same(map(tuple, got)) == same(brute(rows))


def test_odd_texts_repeats_nulls_and_extra_columns(spark):
    rows = [(i % 9 if i % 7 else None, t) for i, t in enumerate(ODD * 2 + EDGES + random_texts(50, 3))]
    docs = table(spark, rows)
    got = alignment.align(docs, A, B).collect()
    assert same(map(tuple, got)) == same(brute(rows))


def test_empty_table(spark):
    got = alignment.align(table(spark, []), A, B)
    assert got.columns == COLUMNS
    assert got.collect() == []


def test_parts_of_a_text_give_the_whole_texts_tokens():
    p = alignment.pair(A, B)
    texts = [t for t in ODD + EDGES[:8] if t] + ["word 12 " * 400 + "  end", "Größe und  Maß, s. 3 " * 90, " x\x1c y\u180e z\u2003 a"]
    texts += [r.text for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").df().itertuples()]
    for text in texts:
        assert " ".join(p.parts(text)) == text
        whole, cut = p.encode([text]), p.encode(p.parts(text))
        assert whole[0].tolist() == cut[0].tolist() and whole[2].tolist() == cut[2].tolist()


def test_remembering_changes_nothing(monkeypatch):
    p = alignment.pair(A, B)
    texts = [t or "" for t in random_texts(30, 5) + ODD]
    want = alignment.Aligned(alignment.Known(p), texts)
    known = alignment.Known(p)
    monkeypatch.setattr(alignment, "REMEMBERED", 20)
    for _ in range(3):
        got = alignment.Aligned(known, texts)
        for name in ("n_a", "n_b", "n_same", "n_odd", "same", "odd", "digests"):
            assert list(getattr(got, name)) == list(getattr(want, name))


def test_identity_pairs_never_end_an_irregular_group():
    p = alignment.pair(A, B)
    got = alignment.Aligned(alignment.Known(p), [t for t in ODD if t] + ["The quick brown fox, 1234567 times: naïveté."])
    a, b = got.odd // len(p.raw_b.size), got.odd % len(p.raw_b.size)
    assert len(got.same) and not (p.same[a] == b).any()


def test_no_row_is_longer_than_a_texts_links(spark):
    """Rows as long as blocks filled the executors' memory outside the heap (op11 on 6 GB)."""
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = alignment.blocks(given.coalesce(1), A, B, "doc_id", "text")
    got = rows.selectExpr("coalesce(length(same), 0) + coalesce(length(odd), 0) as n").collect()
    longest = given.selectExpr("max(octet_length(text)) as n").first().n
    assert len(got) > given.count() and 0 < max(r.n for r in got) <= 8 * (longest + 1)


def test_long_parts_are_remembered_up_to_a_size(monkeypatch):
    known = alignment.Known(alignment.pair(A, B))
    monkeypatch.setattr(alignment, "REMEMBERED_BYTES", 100_000, raising=False)
    for i in range(30):
        alignment.Aligned(known, ["".join(chr(0x4E00 + (i * 7 + j * j) % 20_000) for j in range(5_000))])
        assert sum(map(len, known.place)) + known.held.text.data.nbytes < 200_000


def test_blocks_of_several_slices_and_batches(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(500)
    rows = [(r.doc_id, r.text) for r in given.select("doc_id", "text").collect()]
    rows += [(-1, " ".join(t for _, t in rows)), (-2, ""), (-3, None)]
    assert len(rows[-3][1]) > alignment.SLICE
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, 7)
    try:
        got = alignment.align(table(spark, rows).coalesce(1), A, B).collect()
    finally:
        spark.conf.set(batch, before)
    assert same(map(tuple, got)) == same(brute(rows))
