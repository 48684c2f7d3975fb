import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import prose

from quillion.llm import crosstok

ODD = [
    None, "", " ", "\n", "  two  spaces ", "tail ", "a\n b", "a\n\n  b\nc", "\nlead", "tab\t x \t\ty", "cr\r\nlf\r\n\r\n  z", "nul\0 in\0  side", "a▁b c", "▁", "<s> </s> <unk> <0x41> <|endoftext|>", "it's we'll I'd 'tis",
    "漢字 かな 한글 🧑‍🤝‍🧑 é é", "　wide  space\x85 \x1c q", "x" * 3000, "ab" * 700 + " " * 90 + "end", "�﻿ \U0010ffff", "1234567890 " * 30, "—“quoted”— … ¿qué?", "   x \xa0 y",
]


def both_whole(texts):
    """Ids of whole texts by the tokenizers' own libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(crosstok.A_PATH), sentencepiece.SentencePieceProcessor(model_file=crosstok.B_PATH)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in plain)}
    for text in texts:
        if not text:
            yield [], [], [], []
            continue
        x, y = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        xs = [bytes(byte[c] for c in a.id_to_token(i)) for i in x]
        ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        same = b"".join(xs) == f" {text}".encode() == b"".join(ys)
        yield (x, y, xs, ys) if same else ([], [], [], [])


def plain(texts):
    docs, holders, linked = [], defaultdict(set), []
    for k, (x, y, xs, ys) in enumerate(both_whole(texts)):
        ends_x, ends_y = np.cumsum([len(t) for t in xs]).tolist(), np.cumsum([len(t) for t in ys]).tolist()
        cuts = sorted(set(ends_x) & set(ends_y))
        groups, i, j = [], 0, 0
        for cut in cuts:
            i2, j2 = ends_x.index(cut) + 1, ends_y.index(cut) + 1
            groups.append((x[i:i2], y[j:j2]))
            i, j = i2, j2
        links = Counter()
        for g, h in groups:
            for p in g:
                for q in h:
                    links[p, q] += 1
        for pair in links:
            holders[pair].add(k)
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        docs.append((len(x), len(y), len(groups), hashlib.sha256(shown.encode()).hexdigest() if x else ""))
        linked.append(links)
    counts = {pair: len(who) for pair, who in holders.items()}
    best = defaultdict(int)
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    out = []
    for (n_a, n_b, n_groups, digest), links in zip(docs, linked, strict=True):
        out.append((n_a, n_b, n_groups, sum(links.values()), sum(n for pair, n in links.items() if counts[pair] == best[pair[0]]), sum(n * counts[pair] for pair, n in links.items()), digest))
    return out, counts


def texts_of(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    draw = random.Random(5)
    marks = ["a", "the", " ", "\n", "é", "漢", "\t", "'s", "9", ".", "▁", "🙂", "\r"]
    noise = ["".join(draw.choice(marks) for _ in range(draw.randrange(1, 60))) for _ in range(150)]
    return [r.text for r in rows] + ODD + noise + [prose(1, 50)] * 20


@pytest.mark.parametrize("block_chars", [3000, 1 << 25])
def test_matches_whole_texts(spark, block_chars):
    texts = texts_of(spark)
    want, counts = plain(texts)
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, key string").repartition(3)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in crosstok.align(docs, block_chars=block_chars).collect()}
    assert got == dict(enumerate(want))
    pairs = {(r.a, r.b): r.n_docs for r in crosstok.pair_table(docs, block_chars=block_chars).collect()}
    assert pairs == counts


def test_wide_groups_count_as_others():
    block, wide = (crosstok.Block(crosstok.encoders(crosstok.A_PATH, crosstok.B_PATH)) for _ in range(2))
    wide.WIDE = 1
    texts = [prose(i, 60) + " mixed 漢字漢字 thereaonn " * 3 for i in range(20)]
    assert list(block.read(texts)) == list(wide.read(texts))
    assert wide.wide and not block.wide
    assert [x.tolist() for x in block.fold()] == [x.tolist() for x in wide.fold()] and block.fold()[0].size


def test_very_long_text_repeated_rows_and_empty_table(spark):
    long = prose(3, 150_000)
    docs = spark.createDataFrame([(1, long), (1, long), (None, "one two"), (2, None)], "doc_id long, text string")
    rows = crosstok.align(docs).collect()
    assert len(rows) == 4 and len({r for r in rows if r.doc_id == 1}) == 1
    first = next(r for r in rows if r.doc_id == 1)
    assert first.n_groups > 150_000 and first.count_sum >= 2 * first.n_links * 0.9
    assert next(r for r in rows if r.doc_id == 2)[1:] == (0, 0, 0, 0, 0, 0, "")
    assert crosstok.align(docs.limit(0)).count() == 0
