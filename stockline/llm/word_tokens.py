"""Token ids of a word-piece vocabulary (tokenizers, .json), one distinct pre-token at a time.

Texts repeat their words, so a worker asks the library for each pre-token once and keeps the answer. Texts
of Latin-1 characters are cut by an expression that states the vocabulary file's own cutting rule for that
range; all others are cut by the library's normaliser and pre-tokeniser. Special strings inside a text are
one token each, which is the library's default.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable

from tokenizers import Tokenizer

from stockline.llm.common import worker_value

#: The vocabulary's cutting rule, with the letters, numbers and white space of Latin-1 spelt out.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t-\r \x85\xa0"
LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+")
#: Byte-level pieces write printable bytes as themselves and the others from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {chr(b): b for b in _PRINTED} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}
_SHOWN = {b: c for c, b in _BYTES.items()}
#: Pre-tokens a worker keeps at most; beyond it starts afresh.
KEPT_WORDS = 600_000


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordVocabulary:
    """The library's tokeniser with a memory of the pre-tokens it has met."""

    def __init__(self, path: str, whole: Iterable[str] = ()):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens that change the text around them are not supported")
        self.special = {t.content: i for i, t in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.model = self.library.model
        self.whole = frozenset(whole)
        self.ids: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if is_latin(text):
            return LATIN_WORDS.findall(text.lower())
        text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and special strings of a text, in order."""
        if not any(s in text for s in self.special):
            return self.words(text)
        return [w for part in self.cut.split(text) if part
                for w in ([part] if part in self.special else self.words(part))]

    def merged(self, word: str) -> bytes:
        """The ids of one pre-token, by the library's merges."""
        if word in self.special:
            return array("I", [self.special[word]]).tobytes()
        if not word.isascii() or not word.isprintable():
            word = "".join(map(_SHOWN.__getitem__, word.encode("utf-8")))
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def learn(self, words: set[str]) -> None:
        """Ask the library for all words that are not known yet."""
        missing = [w for w in words.difference(self.ids) if w not in self.whole]
        if len(self.ids) + len(missing) > KEPT_WORDS:
            self.ids.clear()
            missing = [w for w in words if w not in self.whole]
        for word in missing:
            self.ids[word] = self.merged(word)


def vocabulary(path: str, whole: Iterable[str] = (), name: str = "ids") -> WordVocabulary:
    return worker_value(("word vocabulary", path, name), lambda: WordVocabulary(path, whole))


def prove_whole_words(path: str) -> list[str]:
    """The vocabulary strings that, alone, are one pre-token and encode as exactly one token.

    This is done once, before any text is read; the result is no larger than the vocabulary.
    """
    known = WordVocabulary(path)
    library, proven = known.library, []
    for piece in library.get_vocab(with_added_tokens=False):
        if not piece.endswith("</w>"):
            continue
        word = _plain(piece.removesuffix("</w>"))
        if word and word not in known.special and known.words(word) == [word]:
            if len(library.encode(word, add_special_tokens=False).ids) == 1 == len(known.merged(word)) // 4:
                proven.append(word)
    return sorted(proven)


def _plain(mapped: str) -> str:
    """The text behind a piece whose bytes are written as printable characters ('' if it is none)."""
    try:
        return bytes(map(_BYTES.__getitem__, mapped)).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return ""
