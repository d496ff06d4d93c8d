"""Regular expressions and word lists that results depend on."""

# Token alternatives in order of precedence.  ``\p{L}\p{N}_`` stands for
# a Unicode word character, ``\p{Nd}`` for a digit, ``\s\p{Z}`` for white space.  All of them are matched case-insensitively.
PHONE = r"(?:\+?[01][\-\s\p{Z}.]*)?(?:[(]?\p{Nd}{3}[\-\s\p{Z}.)]*)?\p{Nd}{3}[\-\s\p{Z}.]*\p{Nd}{4}"
EMOTICON = (
    r"[<>]?[:;=8][\-o*']?[)\](\[dp/:}{@|\\]+"
    r"|[)\](\[dp/:}{@|\\]+[\-o*']?[:;=8][<>]?"
)
WEB_ADDRESS = r"(?:https?://)?[\p{Nd}a-z.\-]+\.[a-z.]{2,6}[/\p{L}\p{N}_.\-]*/?"
MARKUP_TAG = r"<[^>]+>"
USER_NAME = r"@[\p{L}\p{N}_]+"
HASHTAG = r"#+[\p{L}\p{N}_]+[\p{L}\p{N}_'\-]*[\p{L}\p{N}_]+"
JOINED_WORD = r"[a-z][a-z'\-_]+[a-z]"
NUMBER = r"[+\-]?\p{Nd}+[,/.:\-]\p{Nd}+[+\-]?"
WORD = r"[\p{L}\p{N}_]+"
ELLIPSIS = r"\.(?:[\s\p{Z}]*\.)+"
ANY_SYMBOL = r"[^\s\p{Z}]"

# Fixed value: the mark that replaces a web address.
ADDRESS_MARK = "_url_"
# Fixed value: punctuation that ends the place name in an author's location.
LOCATION_PUNCTUATION = r""",.?;:'"\[{\]}\-_!@&|*()"""
# Fixed value: label of training rows that carry no sentiment.
IRRELEVANT = "irrelevant"

# The English stop words.
STOPWORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his
    himself she her hers herself it its itself they them their theirs themselves what
    which who whom this that these those am is are was were be been being have has had
    having do does did doing a an the and but if or because as until while of at by for
    with about against between into through during before after above below to from up
    down in out on off over under again further then once here there when where why how
    all any both each few more most other some such no nor not only own same so than too
    very s t can will just don should now
    """.split()
)


def alternatives(ellipsis: str) -> str:
    """All token alternatives, in order of precedence."""
    parts = (
        f"(?:{PHONE})", f"(?:{EMOTICON})", f"(?:{WEB_ADDRESS})", MARKUP_TAG, USER_NAME,
        HASHTAG, JOINED_WORD, NUMBER, WORD, ellipsis, ANY_SYMBOL,
    )
    return "|".join(parts)


def token_pattern(ellipsis: str = ELLIPSIS) -> str:
    """All token alternatives as one pattern; group 1 is the token."""
    return f"(?i)({alternatives(ellipsis)})"


# Most tokens are plain words: three letters or more before white space, one of a few marks or the
# end.  No alternative ahead of JOINED_WORD matches there, and it matches the same letters.
PLAIN_WORD = r"[a-z]{3,}+(?=[\s,!?\"]|\z)"
# On the JVM the repeated group is possessive: the match is the same, but a run of
# thousands of dots then loops instead of recursing.  No token starts with white space; one
# look passes it by instead of a try of each alternative.
TOKEN = rf"(?i)((?=[^\s\p{{Z}}])(?:{PLAIN_WORD}|{alternatives(ELLIPSIS + '+')}))"
STARTS_WITH_EMOTICON = f"(?i)^(?:{EMOTICON})"
ADDRESS = f"(?i){WEB_ADDRESS}"
