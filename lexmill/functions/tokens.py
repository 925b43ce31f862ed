"""Tokens and their filters as column expressions over arrays; order and repetitions stay, null stays null."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import lists
from lexmill.functions.clean import bound, clean

WORD = r"[\p{L}\p{N}]+"
SCRIPTS = {"han": r"\p{IsHan}", "letters": r"\p{L}"}


def tokenize(c: Column, pattern: str = WORD) -> Column:
    """Words in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def segment(c: Column, lexicon: Iterable[str]) -> Column:
    """Words of a script without spaces: the longest entry of the lexicon at each place, else one character."""
    words = frozenset(w for w in lexicon if w)
    longest = max(map(len, words), default=1)

    def cut(text: str) -> list[str]:
        out, i = [], 0
        while i < len(text):
            n = next((n for n in range(min(longest, len(text) - i), 1, -1) if text[i : i + n] in words), 1)
            if text[i : i + n].strip():
                out.append(text[i : i + n])
            i += n
        return out

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(cut, na_action="ignore")

    return run(c)


def of_length(tokens: Column, low: int = 2, high: int = 6) -> Column:
    return F.filter(tokens, lambda t: F.length(t).between(low, high))


def _in(t: Column, words: Iterable[str]) -> Column:
    return t.isin(*sorted(words))


def whole(t: Column, pattern: str) -> Column:
    return t.rlike(f"^(?:{pattern})$")


def drop_stop_words(tokens: Column, stop: Iterable[str] = lists.ALL_STOP_WORDS, keep_negative: bool = False, negative: Iterable[str] = lists.ALL_NEGATIVE) -> Column:
    listed = set(stop) - set(negative) if keep_negative else set(stop)
    return F.filter(tokens, lambda t: ~_in(t, listed))


def drop_times(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~whole(t, lists.TIME))


def drop_numbers(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~whole(t, lists.NUMBER))


def drop_places(tokens: Column, places: Column | None = None) -> Column:
    """Without those in an array of places, or that look like one."""
    bare = F.filter(tokens, lambda t: ~whole(t, lists.PLACE))
    return bare if places is None else F.filter(bare, lambda t: ~F.array_contains(places, t))


def keep_script(tokens: Column, script: str = "han") -> Column:
    return F.filter(tokens, lambda t: t.rlike(SCRIPTS[script]))


def filter_tokens(tokens: Column, times: bool = True, places: bool = True, numbers: bool = True, script: str | None = "han", keep_negative: bool = False, gazetteer: Column | None = None) -> Column:
    """The filters in order: stop words, times, places, numbers, script."""
    tokens = drop_stop_words(tokens, keep_negative=keep_negative)
    tokens = drop_times(tokens) if times else tokens
    tokens = drop_places(tokens, gazetteer) if places else tokens
    tokens = drop_numbers(tokens) if numbers else tokens
    return keep_script(tokens, script) if script else tokens


def kept_words(words: pa.Array, script: str | None = "han") -> np.ndarray:
    """Whether each word of `tokenize` passes `filter_tokens`: for distinct words, that columns of repeated ones need not be asked for each."""
    kept = pc.invert(pc.is_in(words, value_set=pa.array(lists.ALL_STOP_WORDS, words.type)))
    for pattern in (lists.TIME, lists.PLACE, lists.NUMBER):
        kept = pc.and_(kept, pc.invert(pc.match_substring_regex(words, f"^(?:{pattern})$")))
    if script:
        kept = pc.and_(kept, pc.match_substring_regex(words, SCRIPTS[script].replace(r"\p{Is", r"\p{")))
    return kept.to_numpy(zero_copy_only=False).astype(bool)


def analyze(c: Column, low: int = 2, high: int = 6, script: str | None = "letters", lexicon: Iterable[str] | None = None) -> Column:
    """Clean, cut into words, keep lengths, filter; with a lexicon words are those of a script without spaces."""
    text = clean(c)
    return filter_tokens(of_length(tokenize(text) if lexicon is None else segment(text, lexicon), low, high), script=script)


def tag(token: Column) -> Column:
    """A part of speech by the word's form, for want of a model: function words, endings, else a noun."""
    rules = [
        (_in(token, lists.ALL_STOP_WORDS), "u"), (token.rlike("^[0-9]"), "m"), (token.rlike("(?:ly|mente|ment)$"), "d"), (token.rlike("(?:ing|ed|er|en|ar|ir)$"), "v"),
        (token.rlike("(?:ble|ous|ive|lich|ig|isch|oso|osa|eux)$"), "a"),
    ]
    out = F.when(*[rules[0][0], rules[0][1]])
    for test, name in rules[1:]:
        out = out.when(test, name)
    return out.otherwise("n")


def tagged(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.struct(t.alias("token"), tag(t).alias("tag")))


def normal_tag(t: Column) -> Column:
    """Finer tags as their plain ones."""
    names = F.create_map(*[F.lit(x) for kv in lists.TAG_NAMES.items() for x in kv])
    return bound(t, lambda x: F.coalesce(F.try_element_at(names, x), x))
