import public_tokenizers as P

from tidemark.llm import token_counts

RUNS = ["a", "Größe,", "x" * 200, "\x01", "a\x01b", "<|endoftext|>", "it's", "漢字", " ", "é", "\x1c", "a.b.c", " "]


def test_lengths_with_marks_long_runs_and_a_small_cache():
    t = token_counts.load(P.path("word_bpe_49k.json"))
    size = {r: len(t.encode(r, add_special_tokens=False).ids) for r in RUNS}
    for kept in (RUNS, [r for r in RUNS if "\x01" not in r]):
        lengths = token_counts.Lengths(t, {"a": size["a"]}, room=3)
        for k in (1, 3, len(kept), 2):
            texts = [kept[i : i + k] + [""] for i in range(0, len(kept), k)]
            for some in (texts, texts[::-1], [[]]):
                assert lengths.sums(some) == [sum(size.get(r, 0) for r in x) for x in some]
            assert all(len(r) <= token_counts.LONGEST for r in lengths.young)


def test_slices_keep_every_text():
    texts = ["", "a" * 10, "b", "", "c" * 3]
    assert [t for some in token_counts.by_size(texts, room=4) for t in some] == texts
    assert list(token_counts.by_size([])) == []
