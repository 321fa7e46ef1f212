"""A worker of the byte encoder that remembers little gives the same ids."""

import public_tokenizers
import regex

from threadsmith.llm import byte_bpe as B


def test_ids_and_size():
    table = B.merge_table(B.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    texts = [" ".join(f"w{i * j}x" for j in range(300)) + " caf\u00e9\n" for i in range(60)]
    pat = regex.compile(public_tokenizers.PATTERN)
    small, large = B.ByteBpe(table, cache_entries=500), B.ByteBpe(table)
    for i in range(0, 60, 3):
        assert small.encode(texts[i:i + 3], pat) == large.encode(texts[i:i + 3], pat)
    block = max(2 * sum(len(t.split()) for t in texts[i:i + 3]) * 3 for i in range(0, 60, 3))
    assert len(small.chunks) + len(small.pre) <= 2 * 500 + block < len(large.chunks) + len(large.pre)
