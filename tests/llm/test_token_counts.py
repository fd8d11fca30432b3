import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftgraph.llm.token_counts import PrefixCounter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [*"ab the'sldrem  \n\t  \x85\x1c　é漢😀09.,!?'", "<|endoftext|>", "'ll", " the", "\r\n"]


@pytest.fixture(scope="module")
def both():
    library = Tokenizer.from_file(PATH)
    return PrefixCounter(PATH), lambda x: len(library.encode(x, add_special_tokens=False).ids)


def texts(n, size, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, size))) for _ in range(n)]


def test_counts_equal_the_library(both):
    counter, count = both
    for x in texts(1500, 25):
        assert counter.count(x) == count(x), x


def test_every_prefix_equals_the_library(both):
    counter, count = both
    for x in texts(250, 20, 2):
        assert counter.table(x).tolist() == [count(x[:i]) for i in range(len(x) + 1)], x


def test_longest_prefix_is_the_longest(both):
    counter, count = both
    for k, x in enumerate(texts(250, 20, 3)):
        assert counter.longest_prefix(x, k % 7) == max(i for i in range(len(x) + 1) if count(x[:i]) <= k % 7), x


def test_prefixes_of_long_words(both):
    counter, count = both
    word = "supercalifragilistic" * 400
    counts = counter.table(word)
    for i in (1, 7, 100, 999, len(word)):
        assert counts[i] == count(word[:i])
    assert counter.longest_prefix(word, 300) == max(i for i in range(1000, 4000) if counts[i] <= 300)


def test_defined_cases(spark, both):
    long = "long text, " * 50000
    rows = [(1, None, 0), (2, "", 0), (3, "é x", 0), (4, long, 0), (4, long, 0), (None, "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    found = sorted((tuple(r) for r in token_counts(df, PATH).collect()), key=str)
    n = both[1](long)
    limit = both[0].longest_prefix(long, 512)
    assert found == sorted([(1, 0, 0, False, 0), (2, 0, 0, False, 0), (3, 4, 2, False, 3), (4, len(long), n, True, limit), (4, len(long), n, True, limit), (None, 1, 1, False, 1)], key=str)
    assert token_counts(df.where("doc_id < 0"), PATH).count() == 0


def test_every_pretoken_is_counted_by_the_pass(both):
    counter, count = PrefixCounter(PATH), both[1]
    own, seen = counter.prefix_counts, []

    def counted(pretoken):
        seen.append(pretoken)
        return own(pretoken)

    counter.prefix_counts = counted
    text = "It's one thing, two things! " + "y" * 300 + " one thing,"
    assert counter.count(text) == count(text)
    assert sorted(seen) == sorted(set(counter.split.findall(text)))  # the memo serves a pretoken that came before, and nothing else does


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))
