"""Tokens and query words as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words (fixed values). Callers can give a list of their own.
STOP_WORDS = tuple("""
a about above across after afterwards again against all almost alone along already also although always am among
amongst amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at back be became
because become becomes becoming been before beforehand behind being below beside besides between beyond bill both
bottom but by call can cannot cant co con could couldnt cry de describe detail do done down due during each eg eight
either eleven else elsewhere empty enough etc even ever every everyone everything everywhere except few fifteen fify
fill find fire first five for former formerly forty found four from front full further get give go had has hasnt have
he hence her here hereafter hereby herein hereupon hers herself him himself his how however hundred ie if in inc
indeed interest into is it its itself keep last latter latterly least less ltd made many may me meanwhile might mill
mine more moreover most mostly move much must my myself name namely neither never nevertheless next nine no nobody
none noone nor not nothing now nowhere of off often on once one only onto or other others otherwise our ours ourselves
out over own part per perhaps please put rather re same see seem seemed seeming seems serious several she should show
side since sincere six sixty so some somehow someone something sometime sometimes somewhere still such system take ten
than that the their them themselves then thence there thereafter thereby therefore therein thereupon these they thickv
thin third this those though three through throughout thru thus to together too top toward towards twelve twenty two
un under until up upon us very via was we well were what whatever when whence whenever where whereafter whereas
whereby wherein whereupon wherever whether which while whither who whoever whole whom whose why will with within
without would yet you your yours yourself yourselves
""".split())

#: Weight of a token by the tag it stands in (fixed values).
TAG_WEIGHTS = {"title": 5.0, "h1": 3.0, "h2": 2.5, "strong": 1.5, "b": 1.5, "p": 1.0, "li": 1.0}


def trim(c: Column) -> Column:
    """c without Unicode white space at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tag_tokens(text: Column) -> Column:
    """Parts between single spaces, trimmed, without empty ones; other white space doesn't split."""
    return F.filter(F.transform(F.split(text, " "), trim), lambda x: x != "")


def joined(tokens: Column) -> Column:
    """Tokens with spaces, and a full stop at the end."""
    return F.concat(F.array_join(tokens, " "), F.lit("."))


def normalized_words(text: Column, min_length: int = 2) -> Column:
    """Lower-case runs of ASCII letters and digits of at least min_length characters; stop words stay."""
    plain = F.regexp_replace(F.lower(text), "[^a-zA-Z0-9]+", " ")
    return F.filter(F.split(plain, " "), lambda x: F.length(x) >= min_length)


def without_stop_words(words: Column, stop_words=STOP_WORDS) -> Column:
    return F.filter(words, lambda x: ~x.isin(*stop_words))


def clean_words(text: Column, stop_words=STOP_WORDS) -> Column:
    """normalized_words without stop words."""
    return without_stop_words(normalized_words(text), stop_words)


def embedding_text(texts: Column) -> Column:
    """The text of a page that is embedded: the tokens of each tag in the order of TAG_WEIGHTS, a full stop and a line end after each."""
    of = lambda tag: F.flatten(F.transform(F.filter(texts, lambda x: x["tag"] == tag), lambda x: tag_tokens(x["text"])))
    return F.concat(*[F.concat(joined(of(tag)), F.lit("\n")) for tag in TAG_WEIGHTS])
