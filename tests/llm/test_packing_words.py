"""Words of a slice are numbered at once."""

from corpuscope.llm.common import data_path
from corpuscope.llm.packing import VOCABULARY, encoder


class Text(bytes):
    def split(self, *_):
        raise AssertionError("each word of a text became a Python object")


def test_words_are_numbered_at_once():
    """op13: all words of a text were made Python objects, repeats included; ids stay those of the tokenizer."""
    own = encoder(data_path(VOCABULARY))
    texts = ["", " ", "a", "the the  the\tThe\n", "\x0b\x0cÉtude, étude.\r\n x\x1cy\x85z w v", "名前 123-456 (ok).", " end", "the"]
    got = [x.tolist() for x in own.encode([Text(t.encode()) for t in texts])]
    assert got == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.encode([]) == []
    assert [len(x) for x in own.encode([Text(b""), Text(b"")])] == [0, 0]
