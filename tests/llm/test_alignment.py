"""Alignment of two tokenizations, against the libraries on whole texts and a search over all pairs of tokens."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import sentencepiece
from helpers import SF, documents
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
from plumbline.llm import alignment
from plumbline.llm.bpe import byte_letters
from plumbline.llm.common import Scratch

A_PATH, B_PATH = alignment.public_vocabularies()


def plain(texts):
    """What the contract says of texts, by the libraries and by comparing all tokens of a text."""
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    letters = byte_letters()

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode()

    found = []
    for text in texts:
        if not text:
            found.append(([], [], [], []))
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [b_bytes(i) for i in ids_b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            found.append(([], [], [], []))
            continue
        span = lambda parts: [(sum(map(len, parts[:k])), sum(map(len, parts[: k + 1]))) for k in range(len(parts))]
        spans_a, spans_b = span(bytes_a), span(bytes_b)
        links = [(i, j) for i, x in enumerate(spans_a) for j, y in enumerate(spans_b) if max(x[0], y[0]) < min(x[1], y[1])]
        cuts = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        groups = [([i for i, s in zip(ids_a, spans_a, strict=True) if lo < s[1] <= hi], [i for i, s in zip(ids_b, spans_b, strict=True) if lo < s[1] <= hi]) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        found.append((ids_a, ids_b, groups, [(ids_a[i], ids_b[j]) for i, j in links]))
    holds = Counter(p for *_, links in found for p in set(links))
    best = defaultdict(int)
    for (x, _), n in holds.items():
        best[x] = max(best[x], n)
    return [
        (len(x), len(y), len(groups), len(links), sum(holds[p] == best[p[0]] for p in links), sum(holds[p] for p in links),
         ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups))
        for x, y, groups, links in found
    ]


TEXTS = [
    None, "", " ", "a", "  two  blanks ", "\n\nlines\tand\r\n", "It's we'll <|endoftext|> <s>x</s> <0x41>", "été über 中文字 ру́сский 😀👩‍👩‍👧 ﬁ", "a▁b",
    "nul\x00byte", "a" * 300, "The quick brown fox. " * 40, "The quick brown fox. " * 40, "1234567890 12 3", "don't  don't don't", " leading", "trailing ",
    "　wide line", "...!!!???" * 20, "\t" * 50 + "x", "The fox", "ÉCOLE naïve coöperate",
]


def aligned(spark, frame, block_bytes=alignment.BLOCK_BYTES):
    scratch = Scratch(spark)
    rows = alignment.align(frame, A_PATH, B_PATH, scratch, block_bytes=block_bytes).collect()
    scratch.remove()
    return rows


def test_rows_equal_all_pairs_of_tokens(spark):
    rows = aligned(spark, documents(spark, enumerate(TEXTS)))
    assert len(rows) == len(TEXTS) and "a.b" in rows[0].__fields__ and "text" not in rows[0].__fields__ and "score" in rows[0].__fields__
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in rows}
    assert got == dict(enumerate(plain(TEXTS)))
    assert got[8][:4] == (0, 0, 0, 0)


def test_query_equals_all_pairs_on_short_texts_of_the_given_table(spark):
    found = {r["doc_id"]: r for r in entry_module.queries()["op11_alignment"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    short = [(r["doc_id"], r["text"]) for r in rows if r["text"] and len(r["text"]) < 1500]
    for (i, _), e in zip(short, plain([t for _, t in short]), strict=True):
        r = found[i]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == e[:4]
        assert r["groups_sha256"] == hashlib.sha256(e[6].encode()).hexdigest()
    assert all(r["groups_sha256"] == "" for r in found.values() if not r["n_a"])
    assert all(r["n_best"] <= r["n_links"] <= r["count_sum"] for r in found.values())


def test_words_encoded_alone_or_together_give_the_tokens_of_whole_texts():
    whole_a = Tokenizer.from_file(A_PATH)
    whole_a.encode_special_tokens = True
    whole_b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    pick = np.random.default_rng(2)
    words = [t for t in " ".join(x or "" for x in TEXTS).split(" ") if len(t) < 60 and "▁" not in t]
    words += ["", "", "don't", "x\n", "\n", "\n\n", "é", "Of", "the", "\x1c", "a\u3000", "\u200b", "\xa0"]
    texts = [" ".join(pick.choice(words, 400)) for _ in range(60)]
    texts += ["y" * 1_200_000, " " * 30_000 + "x", "word " * 4000 + "\n" * 9000 + "end", "!" * 50_000, "w" * 70 + " " + "w" * 70]
    for sides in (alignment.Both(A_PATH, B_PATH), alignment.both(A_PATH, B_PATH)):
        for _ in range(2):
            for text, (a, b) in zip(texts, sides.encoded(texts), strict=True):
                assert a.tolist() == whole_a.encode(" " + text, add_special_tokens=False).ids
                assert b.tolist() == whole_b.encode(text)


def test_repeated_rows_and_an_empty_table(spark):
    rows = aligned(spark, documents(spark, [(1, "one two"), (1, "one two"), (2, "one")]))
    assert sorted((r["doc_id"], r["count_sum"]) for r in rows) == [(1, 5), (1, 5), (2, 3)]
    assert aligned(spark, documents(spark, [])) == []


def test_counts_do_not_depend_on_blocks(spark):
    texts = [t for t in TEXTS for _ in range(3)]
    whole = sorted((r["doc_id"], r["n_best"], r["count_sum"]) for r in aligned(spark, documents(spark, enumerate(texts))))
    small = aligned(spark, documents(spark, enumerate(texts)).repartition(3), block_bytes=200)
    assert sorted((r["doc_id"], r["n_best"], r["count_sum"]) for r in small) == whole
