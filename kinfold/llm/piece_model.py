"""The piece table of a public SentencePiece model, shared by the encoder and the token counter."""

from __future__ import annotations

from dataclasses import dataclass

SPACE = "▁"


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def model_bytes(path: str | None = None) -> bytes:
    """The vocabulary file (about 0.5 MB, a fixed public file), read on the driver and shipped with the task."""
    with open(path or model_path(), "rb") as f:
        return f.read()


@dataclass(frozen=True)
class Pieces:
    """strings and scores by id; normal: ids that text can match; byte_ids[b]: the id of byte b; unk: the unknown id."""

    strings: list[str]
    scores: list[float]
    normal: list[int]
    byte_ids: list[int]
    unk: int


def load(proto: bytes) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    n = sp.get_piece_size()
    strings = [sp.id_to_piece(i) for i in range(n)]
    at = {s: i for i, s in enumerate(strings) if sp.is_byte(i)}
    normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return Pieces(strings, [sp.get_score(i) for i in range(n)], normal, [at.get(f"<0x{b:02X}>", sp.unk_id()) for b in range(256)], sp.unk_id())
