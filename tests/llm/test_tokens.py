import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from stratagraph.llm import bpe, tokens

ODD = ["", " ", "\n", "\n\n", "a\n\nb\n\n\nc\n", "\n\na\n b\n\n c\n\n", "a\n\tb", "\ta\n", "a\n\n \nb", "foo\nBar.\nBaz, qux\nX", "  a", "a\n \nb", "foo \n", "foo\n ", "a \u00a0b", "x" * 3000, "  " * 50 + "é", "a\x1cb\x1c c", "\u3000 a", "日本語 русский हिन्दी 😀😀", "don't we'll I'M", "\t\tif x:\n\t\t\treturn  y\r\n", "<|endoftext|> <|startoftext|>", "a <|endoftext|> b", "word<|endoftext|>word, \n\n<|startoftext|>", " <|EndOfText|> <|endoftext |>", "İSTANBUL ΣΑΣ. ẞ e\u0301. e\u0301\u0301, ½ ² foo.\u0301 bar"]


def texts(n):
    rnd = random.Random(5)
    alphabet = ["a", "B", "cd", "é", "ß", "日", "1", "２", ",", ".", "!", "'", "s", "t", " ", " ", " ", "\n", "\t", "\u00a0", "e\u0301", "😀", "_", "-", "İ", "Σ"]
    return ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 25))) for _ in range(n)]


@pytest.mark.parametrize(("name", "mode"), [("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "leading")])
def test_cached_ids_equal_the_librarys_on_whole_texts(name, mode, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 30_000)
    mine, library = tokens.WordCachedTokenizer(P.path(name), mode), Tokenizer.from_file(P.path(name))
    some = texts(8000)
    for at in range(0, len(some), 500):
        part = some[at : at + 500]
        for text, ids in zip(part, mine.encode(part)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.fixture(scope="module")
def encoder():
    return bpe.PrefixBPE(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def test_prefix_bpe_equals_tiktoken(encoder):
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    for text in texts(4000):
        ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert ids == other.encode_ordinary(text), repr(text)
        assert encoder.decode(ids) == text.encode()


def test_appends_and_edits_are_exact(encoder):
    rnd, words = random.Random(2), list(encoder.ranks)
    for _ in range(200):
        data = b"".join(rnd.choice(words) for _ in range(rnd.randint(1, 60)))
        state = bpe.AppendableEncoding(encoder)
        for k in range(0, len(data), 7):
            state.append(data[k : k + 7])
        assert state.last == encoder.last_tokens(data)
        i = rnd.randint(0, len(data))
        j, new = rnd.randint(i, min(len(data), i + 9)), rnd.choice(words)
        state.edit(i, j, new)
        assert state.data == data[:i] + new + data[j:]
        assert state.last == encoder.last_tokens(state.data)
