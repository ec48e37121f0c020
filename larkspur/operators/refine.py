"""Refinement of crawled text: lines without meaning, navigation, sound sentences, meaningful documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.functions.variants import verb_forms

# Vocabularies of the rules, as text.
STOPWORDS = "a an and are as at away be but by for from has have into in is it its off of on onto or that the their this to was were with your".split()
NAVIGATION = "about account advertisement advertisements apps archive back bbc careers categories contact deals events finance games home homepage latest live login mail main market markets menu more movies news privacy return search settings shop skip signin sign sports subscribe technology terms topics trending video weather".split()
CATEGORIES = "climate consumer culture energy finance geopolitics healthcare markets science sports technology transportation".split()
PRONOUNS = "i you he she it we they me him her us them this that these those someone somebody anyone anybody everyone everybody who which there people person team company government market".split()
CLAUSE_PRONOUNS = "i you he she it we they this these those there".split()
NO_SUBJECTS = "above across after along amid amidst among around behind below beneath beside besides between beyond down inside near outside over through throughout toward towards under underneath up upon within without".split()
STARTERS = "because although though while since unless until if when whenever whereas wherever after before".split()
JOINERS = "and but or so yet for nor because although while since after before though however therefore".split()
AUXILIARIES = "am is are was were be been being has have had do does did can could will would shall should may might must need needs needed seem seems seemed seeming".split()
#: Verbs whose forms follow from the base, and the forms of verbs that do not.
REGULAR = "need seem work call feel try live believe happen provide create support improve deliver launch report announce plan love walk talk study learn monitor play move".split()
IRREGULAR = (
    "am are be been being is was were do does did done can could will would shall should may might must going goes gone go went make makes made take takes taking took taken come comes coming came "
    "run runs running ran sing sings sang sung say says saying said see sees seeing saw seen know knows knowing knew known think thinks thinking thought get gets getting got give gives giving gave given "
    "felt leave leaves leaving left bring brings bringing brought begin begins beginning began begun keep keeps keeping kept hold holds holding held hear hears hearing heard drive drives driving drove driven "
    "lead leads leading led grow grows growing grew grown win wins winning won read reads reading write writes writing wrote eat eats eating ate eaten drink drinks drinking drank drunk build builds building built "
    "planning planned learnt analyze analyzes analyzing analyse analyses analysing analysed"
).split()
VERBS = sorted({*IRREGULAR, *(f for v in REGULAR for f in verb_forms(v))})
#: A small lexicon for use without a word list; read_lexicon() of the readers gives a whole one.
LEXICON = "analysis business company customer data development finance growth innovation insight investment market opportunity performance product research strategy technology trend value ai artificial intelligence learning machine healthcare hospital patient compliance regulation digital platform service solution supply demand global report summary insights".split()

# Lines that say when something was published, how often it was seen, or how it changed.
COUNTERS = [
    r"(?:published|updated)[ \t]+(?:at[ \t]+)?[0-9]{1,2}:[0-9]{2}(?:[ \t]*[a-z]{2,4})?$", r"(?:published|updated)[ \t]+[0-9]{1,2}[ \t]+(?:minute|minutes|hour|hours|day|days)[ \t]+ago$", r"[0-9]+s[ \t]+ago$",
    r"[0-9]{1,3}(?:,[0-9]{3})*[ \t]+(?:viewing|views)(?:[^a-z0-9_]|$)", r"[0-9]{1,2}:[0-9]{2}$", r"revision[ \t]+[0-9]+", r"keywords?[ \t]+added", r"[+-]?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?[ \t]+(?:characters|words)$",
    r"[a-z0-9.-]+[ \t]+·[ \t]*[0-9]+(?:\.[0-9]+)?$", r"(?:high|medium|low)[ \t]*·[ \t]*[0-9]+(?:\.[0-9]+)?$", r"scroll to (?:previous|next) item",
]
COUNTER = "^(?:" + "|".join(COUNTERS) + ")"
_QUOTES = " \t\n\r\x0B\"'“”‘’()\\[\\]{}<>"
OUTER = "^[" + _QUOTES + "]+|[" + _QUOTES + "]+$"
ENDS = "[.!?][\"')\\]}»“”]*$"
VERB_ENDING = "^[a-z]{3,}(?:ed|ing|en|es)$"


def _any(token: Column, words: list[str]) -> Column:
    return token.isin(words)


def plain_words(text: Column) -> Column:
    """Words of letters and inner apostrophes; runs that hold digits are none."""
    runs = F.transform(F.split(tx.text_of(text), r"[^\p{L}\p{N}_']+"), lambda w: F.regexp_replace(w, "^'+|'+$", ""))
    return F.filter(runs, lambda w: w.rlike(r"^[\p{L}']+$"))


def verb_like(word: Column) -> Column:
    """Whether a lower-cased word has the form of a verb."""
    return _any(word, VERBS) | word.rlike(VERB_ENDING)


def has_verb(words: Column) -> Column:
    """Whether some of the words is an auxiliary or has the form of a verb."""
    return F.exists(words, lambda w: _any(F.lower(w), AUXILIARIES) | verb_like(F.lower(w)))


def _tags(words: Column, subject, verb) -> Column:  # noqa: ANN001
    """A letter a word: b for subject and verb, s, v, or o for neither."""
    return F.array_join(F.transform(words, lambda w: F.when(subject(w) & verb(w), "b").when(subject(w), "s").when(verb(w), "v").otherwise("o")), "")


def run_on(sentence: Column) -> Column:
    """Whether a sentence without comma, semicolon or joining word has a subject before a verb twice."""
    words = plain_words(sentence)
    joined = F.exists(words, lambda w: _any(F.lower(w), JOINERS))
    tags = _tags(words, lambda w: _any(F.lower(w), CLAUSE_PRONOUNS) | w.rlike("^[A-Z]"), lambda w: verb_like(F.lower(w)))
    return ~sentence.rlike("[,;]") & ~joined & (F.regexp_count(tags, F.lit("[sb][^vb]*[vb]")) >= 2)


def sound(sentence: Column, lexicon: list[str] = LEXICON) -> Column:
    """Whether a stretch of text is a whole sentence; false for null and empty.

    It begins with a capital letter, ends in a full stop, exclamation or
    question mark, and has two words; in plain ASCII it also has a verb with a
    subject before it, no dependent clause alone, and does not run on.
    """
    bare = F.regexp_replace(tx.text_of(sentence), OUTER, "")
    # The closing mark is looked for with what may follow it.
    words = plain_words(bare)
    subject = lambda w: _any(F.lower(w), PRONOUNS) | ~_any(F.lower(w), STOPWORDS + NO_SUBJECTS) & ~verb_like(F.lower(w)) & (_any(F.lower(w), lexicon) | w.rlike("^[A-Z]"))
    tags = _tags(words, subject, lambda w: verb_like(F.lower(w)))
    dependent = F.lower(bare).rlike("^(?:" + "|".join(STARTERS) + ") ") & ~bare.contains(",")
    english = has_verb(words) & ~dependent & ~run_on(bare) & tags.rlike("^[so]*s[so]*[vb]")
    return bare.rlike(r"^\p{Lu}") & bare.rlike(ENDS) & (F.size(words) >= 2) & (bare.rlike("[^\\x00-\\x7F]") | english)


def sentence_parts(text: Column) -> Column:
    """The stretches of a text between line ends, and behind full stops, exclamation and question marks before white space; trimmed, not empty."""
    cut = F.split(F.regexp_replace(tx.text_of(text), r"([.!?])[ \t\n\x0B\f\r]+", "$1\n"), "[\n\r]+")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")


def navigation_cluster(line: Column) -> Column:
    """Whether a line without digits and closing marks is made of navigation words: two, and half of its words or of at most five; true for an empty line."""
    plain = F.lower(F.trim(tx.text_of(line)))
    words = F.filter(F.split(plain, tx.SPACE), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: _any(w, NAVIGATION)))
    return (plain == "") | ~plain.rlike("[0-9.!?]") & (hits >= 2) & ((hits >= F.size(words) / 2) | (F.size(words) <= 5))


def basic_sentence(line: Column, words: Column) -> Column:
    """Whether at least three words hold a verb and two stopwords, or one beside a capitalised word or a figure."""
    lower = F.lower(line)
    verb = F.exists(F.split(lower, "[^a-z0-9_]+"), lambda w: _any(w, [a for a in AUXILIARIES if not a.startswith(("need", "seem"))]) | w.rlike("^[a-z]{3,}(?:ing|ed)$"))
    stops, capitals = F.size(F.filter(words, lambda w: _any(F.lower(w), STOPWORDS))), F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    return (F.size(words) >= 3) & verb & ((stops >= 2) | (stops >= 1) & ((capitals >= 1) | line.rlike("[0-9]")))


def meaningless(line: Column, lexicon: list[str] = LEXICON) -> Column:
    """Whether a line says nothing: empty, a counter, without letters, with an address, or of names of pages and topics only."""
    plain = F.trim(F.regexp_replace(F.trim(tx.text_of(line)), r"^[\-*•·]+[ \t]*", ""))
    words = F.regexp_extract_all(plain, F.lit("[A-Za-z][A-Za-z']*"), 0)
    n = F.size(words)
    known = F.exists(words, lambda w: _any(F.lower(w), lexicon))
    capitals = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    kinds = F.size(F.array_distinct(F.transform(words, F.lower)))
    navigation, topics = (F.size(F.filter(words, lambda w: _any(F.lower(w), v))) for v in (NAVIGATION, CATEGORIES))
    return (
        F.when((plain == "") | F.lower(plain).rlike(COUNTER) | (n == 0) | F.lower(plain).rlike("https?://"), True).when(known, False)
        .when((kinds == 1) & (n <= 4) | (navigation >= 2) & (navigation >= n / 2) | (topics >= 2) & (topics / n >= 0.6), True)
        .when(n == capitals, False).otherwise(~basic_sentence(plain, words))
    )


def meaningful(text: Column, lexicon: list[str] = LEXICON) -> Column:
    """Whether a text has a sound sentence or a bullet with a verb; or else five words, a verb, and 45 % words that could be known (65 % without a stopword)."""
    plain = tx.text_of(text)
    bullets = F.filter(F.transform(F.split(plain, "[\n\r]+"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[-•·]+[ \t]+"))
    known = lambda w: _any(F.lower(w), lexicon) | F.lower(w).rlike("^[a-z]{3,}$")
    told = F.exists(bullets, lambda b: F.exists(plain_words(b), known) & has_verb(plain_words(b)))
    words = plain_words(plain)
    n, hits = F.size(words), F.size(F.filter(words, known))
    stops = F.size(F.filter(words, lambda w: _any(F.lower(w), STOPWORDS)))
    enough = (n >= 5) & (hits > 0) & has_verb(words) & (hits / F.greatest(n, F.lit(1)) >= 0.45) & ((stops > 0) | (hits / F.greatest(n, F.lit(1)) >= 0.65))
    return F.exists(sentence_parts(plain), lambda s: sound(F.regexp_replace(s, r"^[-•·]+[ \t]*", ""), lexicon)) | told | enough


def highlight_candidates(text: Column) -> Column:
    """Distinct stretches of at least twelve characters, by sentence and by line, without a leading dash, squeezed, cut behind 220 characters."""
    plain = F.trim(F.regexp_replace(tx.text_of(text), "\r\n?", "\n"))
    sentences = F.split(F.regexp_replace(plain, r"([.!?])[ \t\n\x0B\f]+([\p{L}0-9])", "$1\u0001$2"), "\u0001")
    trimmed = F.filter(F.transform(F.concat(sentences, F.split(plain, "\n+")), lambda s: F.trim(F.regexp_replace(s, tx.SPACE, " "))), lambda s: F.length(s) >= 12)
    bare = F.transform(trimmed, lambda s: F.trim(F.regexp_replace(s, "^- ", "")))
    return F.array_distinct(F.transform(bare, lambda s: F.when(F.length(s) > 220, F.concat(F.trim(F.substring(s, 1, 220)), F.lit("…"))).otherwise(s)))


def neighbours(words: Column) -> Column:
    """Each word with the one before and behind it; null at the ends."""
    return F.transform(words, lambda w, i: F.struct(F.when(i > 0, F.get(words, i - 1)).alias("before"), w.alias("word"), F.get(words, i + 1).alias("behind")))


def context(words: Column, at: Column, before: int = 3, behind: int = 4) -> Column:
    """The words around a place (from 0), so many before and behind it."""
    begin = F.greatest(F.lit(0), at - before)
    return F.slice(words, begin + 1, at + behind + 1 - begin)
