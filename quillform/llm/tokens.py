"""Token ids of a public tokenizer file, inside executors."""

from __future__ import annotations

import functools
import json
import os

import numpy as np

#: How byte-level tokenizers write bytes: printable ones as themselves, the others from U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE = {chr(b): b for b in _PLAIN} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}


class Encoder:
    """``encode(text)``: the ids that ``tokenizers`` gives with add_special_tokens=False, as an array.

    A plain byte-level BPE file without special handling is run by ``tiktoken`` from the ranks in that very file, which
    gives the same ids four times as fast; any other file is run by ``tokenizers`` itself.
    """

    def __init__(self, path: str, markers: tuple[str, ...] = ()):
        """``markers`` are special tokens that get new ids after the file's own."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._entries = spec["model"]["vocab"]
        self._fast = self._ranks(spec, markers)
        if self._fast is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(path)
            if markers:
                self._slow.add_special_tokens(list(markers))
        else:
            #: Bytes of each token.
            self._bytes = np.zeros(self._fast.max_token_value + 1, np.int64)
            for i in range(self._fast.n_vocab):
                try:
                    self._bytes[i] = len(self._fast.decode_single_token_bytes(i))
                except KeyError:  # ids may have gaps
                    continue

    @staticmethod
    def _ranks(spec: dict, markers: tuple[str, ...]):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        plain = (
            model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not spec.get("normalizer")
            and all(not any(x.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized")) for x in spec.get("added_tokens", []))
        )
        if not plain:
            return None
        ranks = {bytes(_BYTE[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in added}
        # Ranks stand for the merges only if ids rise with them and every longer piece is some merge's result.
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [ranks.get(bytes(_BYTE[c] for c in a + b), -1) for a, b in pairs]
        if made != sorted(set(made)) or len(made) + 256 != len(ranks) or -1 in made:
            return None
        import tiktoken

        top = max([*model["vocab"].values(), *added.values()]) + 1
        added |= {m: top + k for k, m in enumerate(m for m in markers if m not in added)}
        # The pattern of byte-level pre-tokenization with its regular expression.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.array([], np.uint32)
        if self._fast is None:
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self._fast.encode(text, allowed_special="all", disallowed_special=()), np.uint32)

    def encode_plain(self, text: str) -> np.ndarray:
        """``encode`` where strings of special tokens are ordinary text."""
        if self._fast is not None:
            return np.array(self._fast.encode_ordinary(text), np.uint32)
        self._slow.encode_special_tokens = True
        try:
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)
        finally:
            self._slow.encode_special_tokens = False

    @functools.cached_property
    def token_bytes(self) -> list[bytes]:
        """The bytes of each id by byte-level decoding of its entry; none where there is no such id."""
        entries = self._entries
        table = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            table[i] = bytes(_BYTE[c] for c in entry) if all(c in _BYTE for c in entry) else entry.encode()
        return table

    def encode_with_offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids, and the first and the last character (exclusively) that each token has bytes of."""
        if self._fast is None:
            got = self._slow.encode(text, add_special_tokens=False)
            return np.array(got.ids, np.uint32), np.array(got.offsets, np.int64).reshape(-1, 2)
        ids = self.encode(text)
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        end = np.cumsum(self._bytes[ids])
        return ids, np.stack([char[end - self._bytes[ids]], char[end - 1] + 1], axis=1) if len(ids) else np.zeros((0, 2), np.int64)


class PieceEncoder:
    """Ids and token bytes of a ``sentencepiece`` model, which puts a blank in front of a text."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        #: A piece in UTF-8 with U+2581 as a blank; pieces of single bytes as that byte.
        self.token_bytes = [self._decode(i) for i in range(self._model.get_piece_size())]

    def _decode(self, i: int) -> bytes:
        piece = self._model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._model.is_byte(i) else piece.replace("\u2581", " ").encode()

    def encode_plain(self, text: str) -> np.ndarray:
        return np.array(self._model.encode(text), np.uint32)


@functools.lru_cache(maxsize=4)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


@functools.lru_cache(maxsize=4)
def encoder(path: str, markers: tuple[str, ...] = ()) -> Encoder:
    """One encoder for each file and its markers in a worker process."""
    return Encoder(path, markers)


def default_path() -> str:
    """The byte-level tokenizer of the production queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_path() -> str:
    """The piece tokenizer that the production query holds against it."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
