"""Words and tokens, counted in Python workers with bounded caches."""

from __future__ import annotations

import base64
import re
import unicodedata

WORD = re.compile(r"\w+")
UNIT = re.compile(r"\s*\S+|\s+")
#: Where the public vocabularies lie; a parameter of every operator that counts tokens.
TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary above.
TOKENIZER_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


HIDDEN = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
# Letters of other scripts that look like Latin ones, lower case.
LOOK_ALIKES = str.maketrans("авсеԁһіјкӏмпорԛѕтугхωαεικνορτυχ", "abcedhijklmnopqstyrxwaeikvoptux")


def visible(text: str) -> str:
    """The composed form without characters that don't show."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    for c in HIDDEN:  # a search for one character is far faster than a class of them
        if c in text:
            text = text.replace(c, "")
    return text


def composed(text: str) -> str:
    """Lower case in composed form, without characters that don't show."""
    return visible(text).lower()


def spelled(text: str) -> list[str]:
    """Words of a composed text as they are written; an underscore is no letter."""
    return WORD.findall(text.replace("_", " "))


def plain(word: str) -> str:
    """A lower-case word without accents and look-alikes of other scripts."""
    if word.isascii():
        return word
    bare = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return bare.translate(LOOK_ALIKES)


def words_of(text: str) -> list[str]:
    """Lower-case words without accents, look-alikes and punctuation."""
    return [plain(w) for w in spelled(composed(text))]


class Cache(dict):
    """A dict that computes what is missing and empties itself at ``limit``
    entries; results never depend on what it holds."""

    def __init__(self, make, limit: int = 500_000) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


_COUNTERS: dict[tuple[str, str], Cache] = {}


def token_counter(path: str = TOKENIZER_FILE, pattern: str = TOKENIZER_PATTERN):
    """``text -> number of tokens`` of a byte-level BPE vocabulary.

    The split pattern never joins characters across the end of a
    non-space run, so the units ``spaces + non-spaces`` are tokenised on their
    own and cached; the sum equals the count of the whole text.
    """
    key = (path, pattern)
    if key not in _COUNTERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _COUNTERS[key] = Cache(lambda unit: len(encoding.encode_ordinary(unit)))
    cache = _COUNTERS[key]
    get = cache.__getitem__
    return lambda text: sum(map(get, UNIT.findall(text)))
