"""New runs go to the tokenizers in parts."""

import numpy as np

from corpuscope.llm import align as A
from corpuscope.llm.common import data_path


class Watched:
    def __init__(self, tokenizer):
        self.tokenizer, self.most = tokenizer, 0

    def encode_batch_fast(self, runs, **kw):
        self.most = max(self.most, len(runs))
        return self.tokenizer.encode_batch_fast(runs, **kw)


def test_new_runs_are_encoded_in_parts():
    """op12: all new runs of a slice were encoded at once, which took some hundreds of MB."""
    own = A.Aligner(data_path(A.A_FILE), data_path(A.B_FILE))
    texts = [" ".join(f"w{i}x{k}" for i in range(9000)) for k in range(2)] + ["", None, "a  b", "é́ \x00", "one two"]
    whole = A.Aligner(data_path(A.A_FILE), data_path(A.B_FILE))
    told = [whole.runs([t])[0] for t in texts]
    own.a = Watched(own.a)
    found = own.runs(texts)
    assert own.a.most <= 4096
    links = lambda o, at: [o.pairs[o.first[k] : o.first[k + 1]].tolist() for k in at.tolist()]
    for x, y in zip(found, told):
        assert [own.names[k] for k in x.tolist()] == [whole.names[k] for k in y.tolist()]
        assert np.array_equal(own.sizes[x], whole.sizes[y]) and links(own, x) == links(whole, y)
    assert [len(x) for x in found[2:4]] == [0, 0]
