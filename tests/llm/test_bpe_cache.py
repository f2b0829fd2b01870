"""What was encoded before neither changes a result nor is merged again while it is in use."""

import public_tokenizers as P

from tidewell.llm import bpe


def vocabulary():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return bpe.WordBpe(f.read())


def test_words_in_use_are_merged_once(monkeypatch):
    monkeypatch.setattr(bpe, "_CACHE_ENTRIES", 50)
    merged, merge = [], bpe.merge_word
    monkeypatch.setattr(bpe, "merge_word", lambda parts, *rest: merged.append(tuple(parts)) or merge(parts, *rest))
    own = vocabulary()
    usual = "Grüße, grüße grüße. the The THE, (the) the."
    text = " ".join(f"{usual} rare{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    got = own.encode(text)
    assert max(map(merged.count, set(merged))) == 1  # the cache is full many times, yet words of each line stay
    assert len(own._young) <= 50 and len(own._old) <= 50
    fresh = vocabulary()
    want = []
    for chunk in text.split():
        fresh.forget()
        want += fresh.encode(chunk)
    assert got == want


def test_chunks_do_not_mix_with_words(monkeypatch):
    own = vocabulary()
    for text in ("\u0130x i\u0307x", "e\u0301 \u00e9 E\u0301", "'S 's it's S", "\u03a3 \u03c3 \u0391\u03a3", "The the THE"):
        fresh = vocabulary()
        assert own.encode(text) == fresh.encode(text)
        assert own.decode(own.encode(text)) == " ".join(p[3] for p in fresh.pieces(text))
