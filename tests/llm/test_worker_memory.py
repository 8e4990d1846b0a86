import sys


def test_remembered_pieces_are_bounded_with_their_objects(monkeypatch):
    from ratewise.llm import segment_bpe

    monkeypatch.setattr(segment_bpe, "REMEMBER", 1 << 20)
    codec = segment_bpe.Codec([bytes([b]) for b in range(256)], r"\S+|\s+")
    for k in range(200):
        words = [f"w{k * 200 + i:07d}" for i in range(200)]
        assert codec.encode_all([" ".join(words)]) == [b"".join(b.to_bytes(4, "little") for b in " ".join(words).encode())]
    real = sys.getsizeof(codec.seen) + sum(sys.getsizeof(p) + sys.getsizeof(x) for p, x in codec.seen.items())
    assert real < 1.5 * segment_bpe.REMEMBER
