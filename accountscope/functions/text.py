"""Token expressions on string and ``ARRAY<STRING>`` columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Runs of word characters, or runs of other non-space characters.
# The classes are spelled out because \w and \s are ASCII-only in the JVM.
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\p{Z}\x{85}\x{1c}-\x{1f}"
WORDPUNCT = rf"[{WORD}]+|[^{WORD}{SPACE}]+"
MENTION = rf"@[{WORD}]+"
LINK = "http"
# Fixed value: tokens made of ASCII punctuation only, or of nothing.
PUNCTUATION = r"^[!-/:-@\[-`{-~]*$"

# English stopwords.
ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had having
do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't
couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn
mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't
wouldn wouldn't
""".split()

# Further words dropped from posts.
CUSTOM_STOPWORDS = [
    "–", "’", "u", "”", "”.", "“", "say", "saying", "sayings", "says", "us", "un", '."', "would",
    "let", ".”", "said", ",”", "ax", "max", "b8f", "g8v", "a86", "pl", "145", "ld9", "0t", "34u",
]

STOPWORDS = tuple(ENGLISH_STOPWORDS + CUSTOM_STOPWORDS)


def explode_terms(df: DataFrame, array: Column | str, name: str, *keep: str) -> DataFrame:
    """One row per array entry beside the ``keep`` columns.

    The outer form on purpose: for the inner one the optimizer adds a non-empty
    test, which would evaluate the whole token expression a second time, and
    before any repartitioning.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def wordpunct(text: Column) -> Column:
    """Lower-case, then split into word runs and punctuation runs."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDPUNCT), F.lit(0))


def strip_token(token: Column) -> Column:
    """Trim white space, then ``_``, then ``*``, at both ends."""
    return F.btrim(F.btrim(F.btrim(token), F.lit("_")), F.lit("*"))


def strip_tokens(tokens: Column) -> Column:
    return F.transform(tokens, strip_token)


def drop_punct(tokens: Column) -> Column:
    """Drop empty tokens and tokens of ASCII punctuation; order and repeats stay."""
    return F.filter(tokens, lambda t: ~F.rlike(t, F.lit(PUNCTUATION)))


def drop_stopwords(tokens: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Drop stopwords; a literal set lookup, order and repeats stay."""
    return F.filter(tokens, lambda t: ~t.isin(*stopwords))


def clean_tokens(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Tokens of a text after stripping, punctuation and stopword removal, in two array passes."""
    return F.filter(
        F.transform(wordpunct(text), strip_token),
        lambda t: ~F.rlike(t, F.lit(PUNCTUATION)) & ~t.isin(*stopwords),
    )


def ngrams(tokens: Column, low: int = 1, high: int = 2, carried: Column | None = None) -> Column:
    """All n-grams for ``low <= n <= high`` over one flat token list, joined by a space.

    ``carried`` holds up to ``high - 1`` tokens that come just before this list
    (the tail of an earlier part); n-grams that end inside ``tokens`` are made.
    """
    lead = F.lit(0) if carried is None else F.size(carried)
    run = tokens if carried is None else F.concat(carried, tokens)
    grams = []
    for n in range(low, high + 1):
        if n == 1:
            grams.append(tokens)
            continue
        # Start so that the last token of the gram lies in `tokens`.
        first = F.greatest(lead - F.lit(n - 2), F.lit(1))
        room = F.greatest(F.size(run) - F.lit(n - 1) - first + F.lit(1), F.lit(0))
        gram = F.slice(run, first, room)
        for offset in range(1, n):
            gram = F.zip_with(gram, F.slice(run, first + F.lit(offset), room), lambda a, b: F.concat_ws(" ", a, b))
        grams.append(gram)
    return F.concat(*grams) if len(grams) > 1 else grams[0]
