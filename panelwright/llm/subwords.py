"""Tokenizer files as tasks use them: read once by the driver, known by their contents, built once per worker.

``cut`` divides a text before every single space between two characters that are not white space. Three kinds of files give
the same tokens for the pieces as for the whole text, which ``Library.cuts`` finds out from their definitions: byte-level
pre-tokenizers of the usual pattern (a space only ever begins a match), pre-tokenizers that drop white space, and sentence
pieces none of which has a space after another character. Any other file gets whole texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import cached_property

from pyspark.sql import SparkSession

cut = re.compile(r"(?<=\S) (?=\S)").split

#: The pattern of a pre-tokenizer that keeps words, digits and signs and drops white space (a fixed value of the file format).
WORDS_ONLY = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Normalisers that change characters one by one or by neighbours that are not spaces.
LOCAL = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "Replace"}


class Library:
    """One tokenizer of the library that its file is for: tokenizers for .json, sentencepiece for .model.

    ``plain``: the strings of special tokens inside texts are ordinary text; otherwise they are handled as the library does."""

    def __init__(self, name: str, content: bytes, plain: bool):
        self.name, self.content, self.plain = name, content, plain
        if name.endswith(".json"):
            from tokenizers import Tokenizer

            self.json = Tokenizer.from_buffer(content)
            self.json.encode_special_tokens = plain
            self.json.no_truncation()
            self.json.no_padding()
        elif name.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor()
            self.model.LoadFromSerializedProto(content)
        else:
            raise ValueError(f"a tokenizer file ends in .json or .model, not {name}")

    @cached_property
    def is_json(self) -> bool:
        return self.name.endswith(".json")

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text, without begin, end or other added ones."""
        if self.is_json:
            return [len(e) for e in self.json.encode_batch_fast(texts, add_special_tokens=False)]
        return [len(i) for i in self.model.encode(texts, num_threads=1, return_type="numpy")]

    @cached_property
    def drops_spaces(self) -> bool:
        """Whether runs of white space count like one space and the ends of a text do not count."""
        if not self.is_json:
            return False
        d = json.loads(self.content)
        steps = _steps(d["normalizer"], "normalizers")
        return _words_only(d) and not _spaced(d) and any(s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in steps)

    @cached_property
    def cuts(self) -> bool:
        """Whether ``cut`` leaves the tokens as they are (a piece standing for a space and the piece)."""
        if not self.is_json:
            pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
            return self.model.encode("a", return_type=str)[0].startswith("▁") and not any("▁" in p.lstrip("▁") for p in pieces)
        d = json.loads(self.content)
        if _spaced(d):
            return False
        steps = _steps(d["normalizer"], "normalizers")
        local = all(s["type"] in LOCAL and (s["type"] != "Replace" or (s["pattern"] == {"Regex": r"\s+"} and s["content"] == " ")) for s in steps)
        byte_level = (d["pre_tokenizer"] or {}).get("type") == "ByteLevel" and d["pre_tokenizer"]["use_regex"] and not d["pre_tokenizer"]["add_prefix_space"]
        return d["model"]["type"] == "BPE" and ((byte_level and not steps) or (local and _words_only(d)))


def _steps(node: dict | None, several: str) -> list[dict]:
    return [] if node is None else node[several] if node["type"] == "Sequence" else [node]


def _spaced(d: dict) -> bool:
    """Whether an added token looks at the characters around it or has white space."""
    return any(any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in d["added_tokens"])


def _words_only(d: dict) -> bool:
    steps = _steps(d["pre_tokenizer"], "pretokenizers")
    first = steps[0] if steps else {}
    rest = all(s["type"] == "ByteLevel" and not s["use_regex"] and not s["add_prefix_space"] for s in steps[1:])
    return first.get("type") == "Split" and first["pattern"] == {"Regex": WORDS_ONLY} and first["behavior"] == "Removed" and first["invert"] and rest


def read(path: str, plain: bool = False) -> Library:
    """The tokenizer of a file, for the driver."""
    return Library(os.path.basename(path), _content(path), plain)


def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def version(path: str, *more: str) -> str:
    """Digest of a tokenizer's contents, kind and library version: equal digests give equal tokens."""
    import sentencepiece
    import tokenizers

    kind = f"tokenizers {tokenizers.__version__}" if path.endswith(".json") else f"sentencepiece {sentencepiece.__version__}"
    return hashlib.sha256(b"\0".join([_content(path), kind.encode(), *(m.encode() for m in more)])).hexdigest()


_built: dict[tuple, Library] = {}


def library_for(key: tuple, sent) -> Library:
    """The worker's tokenizer of these contents."""
    if key not in _built:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _built[key] = Library(*sent.value)
    return _built[key]


def shared_library(spark: SparkSession, path: str, plain: bool):
    """A function that gives a task its worker's tokenizer; the file (a fixed one of some MB) is read by the driver."""
    content = _content(path)
    name = os.path.basename(path)
    key = (name, plain, hashlib.sha256(content).hexdigest())
    sent = spark.sparkContext.broadcast((name, content, plain))
    return lambda: library_for(key, sent)
