import random
from collections import Counter, defaultdict
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rankloom.llm import queries, token_alignment
from rankloom.llm.token_alignment import Files

JSON, RANKS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
FILES = Files(RANKS, PIECES, public_tokenizers.PATTERN)
TRAPS = ["a", "é", " ", "  ", "\n", "'s", "9", "12", "<|endoftext|>", "<s>", "</s>", "<0x41>", "日本", "\t ", "the ", " word", "👩‍👧", "x" * 30]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def tokens_of(tools, text):
    """[(id, bytes)] in A and B, or two empty lists; read straight from the libraries."""
    a, b = tools
    letters = {v: k for k, v in token_alignment._byte_of_letter().items()}
    back = {c: k for k, c in letters.items()}
    left = [(n, bytes(back[c] for c in a.id_to_token(n))) for n in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for n in b.encode(text):
        piece = b.id_to_piece(n)
        right.append((n, bytes([int(piece[3:5], 16)]) if b.is_byte(n) else piece.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    if not text or any(b"".join(x for _, x in side) != raw for side in (left, right)):
        return [], []
    return left, right


def groups_of(left, right):
    """Groups as ([A ids], [B ids]), by walking both lists."""
    groups, at_a, at_b, i, j = [], 0, 0, 0, 0
    now = ([], [])
    while i < len(left) or j < len(right):
        if at_a <= at_b and i < len(left):
            now[0].append(left[i][0])
            at_a += len(left[i][1])
            i += 1
        else:
            now[1].append(right[j][0])
            at_b += len(right[j][1])
            j += 1
        if at_a == at_b and now[0] and now[1]:
            groups.append(now)
            now = ([], [])
    return groups


def brute(tools, docs):
    found = []
    held = Counter()
    for doc, text in docs:
        left, right = tokens_of(tools, text or "")
        groups = groups_of(left, right)
        links = Counter((a, b) for g in groups for a in g[0] for b in g[1])
        held.update(links.keys())
        found.append((doc, left, right, groups, links))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for doc, left, right, groups, links in found:
        text = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        out.append(
            (
                doc,
                len(left),
                len(right),
                len(groups),
                sum(links.values()),
                sum(n for p, n in links.items() if held[p] == best[p[0]]),
                sum(n * held[p] for p, n in links.items()),
                sha256(text.encode()).hexdigest() if left else "",
            )
        )
    return sorted(out, key=repr)


def rows_of(frame):
    names = ("doc_id", *token_alignment.RESULTS)
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


def trap_docs(seed, n, parts=40):
    source = random.Random(seed)
    docs = [(k, "".join(source.choice(TRAPS) for _ in range(source.randint(1, parts)))) for k in range(n)]
    docs += [(None, None), (1, ""), (2, " "), (3, "a▁b"), (4, "\x00 nul"), (5, "  two  blanks "), (6, "aaaa" * 50), (7, "ab cd")]
    return docs + docs[:3]


@pytest.mark.parametrize("files", [FILES, Files(JSON, PIECES)])
def test_as_by_walking(spark, tools, files):
    docs = trap_docs(1, 60)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert rows_of(token_alignment.align(frame, files)) == brute(tools, docs)


def test_rare_pairs_small_blocks_and_cuts(spark, tools, monkeypatch):
    docs = trap_docs(2, 60)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    expected = brute(tools, docs)
    for hot, pairs, held, chars in ((1, 1, 1, 1), (20, 7, 30, 60), (1 << 16, 100, 1 << 20, 1 << 18)):
        monkeypatch.setattr(token_alignment, "HOT_PAIRS", hot)
        monkeypatch.setattr(token_alignment, "BLOCK_PAIRS", pairs)
        monkeypatch.setattr(token_alignment, "HELD_PAIRS", held)
        monkeypatch.setattr(token_alignment, "BLOCK_CHARS", chars)
        assert rows_of(token_alignment.align(frame, FILES, chunk=10)) == expected


def test_whole_table(spark, data_dir, tools):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    assert rows_of(queries.op13_token_alignment(spark, data_dir)) == brute(tools, docs)


def test_small_blocks_in_one_process(monkeypatch):
    """Settings of a worker's module, which the session's workers would not see."""
    tools, texts = token_alignment.aligner(FILES), [t for _, t in trap_docs(3, 40) if t]
    parts = [(k, part) for k, text in enumerate(texts) for part in tools.parts(text, 10)]
    found = []
    for pairs, held, block in ((1 << 21, 1 << 20, len(parts)), (1, 1, 1), (5, 20, 7)):
        monkeypatch.setattr(token_alignment, "BLOCK_PAIRS", pairs)
        monkeypatch.setattr(token_alignment, "HELD_PAIRS", held)
        docs = token_alignment.Documents(tools, len(texts))
        for start in range(0, len(parts), block):
            some = parts[start : start + block]
            docs.add([k for k, _ in some], [part for _, part in some])
        found.append([column.to_pylist() for column in docs.columns()])
    assert found[0] == found[1] == found[2] and any(found[0][8])


def test_ranks_and_json_are_one_vocabulary(prose):
    source = random.Random(5)
    ranks = token_alignment._rank_vocabulary(RANKS, public_tokenizers.PATTERN)
    written = token_alignment._json_vocabulary(JSON)
    assert written.bytes[: len(ranks.bytes)] == ranks.bytes and len(written.bytes) == len(ranks.bytes) + 1
    readable = [t.decode() for t in ranks.bytes if t.isascii()]
    texts = ["".join(source.choice(readable) for _ in range(400)) for _ in range(200)] + [prose(3000, 1)]
    texts += ["".join(source.choice(TRAPS) for _ in range(200)) for _ in range(100)]
    texts += ["".join(chr(c) for c in range(start, start + 64)) for start in range(0x20, 0x3000, 64)]
    assert ranks.encode(texts) == written.encode(texts)


def test_parts_are_encoded_as_the_whole(prose):
    tools = token_alignment.aligner(FILES)
    text = prose(20_000, 3) + " " * 500 + "x" * 9000 + " é_1 z" * 900
    parts = list(tools.parts(text, 200))
    assert len(parts) > 100 and " ".join(parts) == text
    for side in (tools.a, tools.b):
        assert [n for ids in side.encode(parts) for n in ids] == side.encode([text])[0]


def test_a_very_long_text_and_one_giant_group(spark, tools):
    docs = [(1, " ".join(f"word{k % 977}" for k in range(60_000))), (2, "\n" * 3000), (3, "é" * 40_000)]
    found = rows_of(token_alignment.align(spark.createDataFrame(docs, "doc_id long, text string"), FILES))
    assert found == brute(tools, docs)


def test_other_names_clashes_and_empty_tables(spark, tools):
    docs = spark.createDataFrame([("x", "hello world", 1, 2, 3)], "id string, body string, row int, N_A int, text int")
    found = token_alignment.align(docs, FILES, key="id", text="body")
    assert found.columns == ["id", *token_alignment.RESULTS]
    (row,) = found.collect()
    assert [tuple(row)] == brute(tools, [("x", "hello world")])
    assert token_alignment.align(docs.limit(0), FILES, key="id", text="body").collect() == []
