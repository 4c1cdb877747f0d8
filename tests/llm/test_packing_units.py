"""Units of new words go to the merges in lines."""

from corpuscope.llm.common import data_path
from corpuscope.llm.packing import UNITS, VOCABULARY, WordEncoder


class Watched:
    def __init__(self, tokenizer):
        self.tokenizer, self.lines = tokenizer, 0

    def encode_batch_fast(self, lines, **kw):
        self.lines += len(lines)
        return self.tokenizer.encode_batch_fast(lines, **kw)


def test_units_go_to_the_merges_in_lines():
    """op13: each new unit was a call of the merges, and its tokens Python objects; ids stay those of the tokenizer."""
    own = WordEncoder(data_path(VOCABULARY))
    words = [f"{a}{b}{c}" for a in ("the", "Ñandú", "ÀÉ", "x", "ßÿþ", "ZQX") for b in ("", "ing", "ção", "WORD") for c in ("", ".", "...", "!?", "),")]
    odd = ["12a", "a-b", "…", "名前", "it's", "µ", "×", "é"]
    texts = [" ".join(words), " ".join(odd), " ".join(x for pair in zip(words, odd * 20) for x in pair), "", "?", "a"]
    own.merges = Watched(own.merges)
    got = [x.tolist() for x in own.encode([t.encode() for t in texts])]
    assert got == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert 0 < own.merges.lines <= -(-len(words) // UNITS) + 1
    assert not own.encode([b""])[0].size and own.encode([]) == []
