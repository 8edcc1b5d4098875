"""Pieces of letters, digits and other characters are encoded by their runs, which are remembered."""

from adjudica.llm import token_blocks


def test_runs_are_remembered():
    enc = token_blocks.Encoder(token_blocks._path("byte_bpe_50k.json"))
    texts = ["a-1 b-2 (c) http://a.b/c1 x_y", "b-1 a-2 (a) http://c.a/b1 y_x"]
    want = [enc.whole(x) for x in texts]
    assert enc(texts[0]) == want[0]
    asked, whole = [], enc.whole
    enc.whole = lambda x: asked.append(x) or whole(x)
    assert enc(texts[1]) == want[1] and not [x for x in asked if len(x.strip()) > 3]
    for odd in ("it's-1 'll-x a'1", "x\t1-2  3", "\x1cа-1 é-2 1²"):
        assert enc(odd) == whole(odd)
