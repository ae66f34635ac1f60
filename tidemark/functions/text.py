"""Text expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a query or a text as of one kind.
TEMPORAL = ("when", "ago", "before", "after", "first", "last", "recent", "recently", "long", "sequence", "order", "earliest", "latest", "previous", "prior", "since")
UPDATE = ("currently", "anymore", "still", "current")
NEGATIONS = ("not ", "no ", "never ", "does not", "do not", "is not", "are not", "cannot", "can't", "don't", "doesn't", "isn't", "won't", "wasn't", "weren't", "didn't", "hasn't", "haven't", "hadn't")
PAST = ("was ", "were ", "previously ", "used to ", "had been ", "no longer ")
PRESENT = (" is ", " are ", " now ", "currently ", "today ")
VERSION = r"v?\d+\.\d+(?:\.\d+)*"
CONFIG_PATTERNS = (r"(?i)(postgresql|postgres|redis|mongodb|mysql|https?)://\S+", r"\S+\s*(→|->)\s*\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}:\d{2,5}", r"[A-Z][A-Z0-9_]+=https?://\S+")
URL = r"https?://\S+"
PHONE = r"\+\d[\d\-]{7,}|\(\d{3}\)\s?\d{3}[\-\s]\d{4}|\d{3}[\-\s]\d{3}[\-\s]\d{4}"
AGGREGATION = r"(?i)\b(how many(?: times)?|how often|how much total|total number of|sum of|count of|list (?:all|every|everything)|every time|all occasions?)\b"
MONETARY = r"(?i)\bhow much\b.*\b(save|saved|spend|spent|raised?|earn|earned|in total|altogether)\b"
TEMPORAL_QUANTITY = r"(?i)\bhow many (days?|weeks?|months?|years?) (ago|before|after)\b"


# What says that a text or a query is about preferences, and what looks like it and isn't.
PREFERENCE_WORDS = (
    "prefer", "prefers", "preferred", "favorite", "favourite", "enjoy", "enjoys", "enjoyed", "like", "love", "loves", "loved", "hate", "hates", "hated", "dislike", "dislikes", "disliked",
    "adore", "adores", "adored", "detest", "detests", "detested", "allergic", "vegetarian", "vegan", "avoid", "avoids",
)
PREFERENCE_QUERY = (*PREFERENCE_WORDS, "likes", "liked", "interested")
PREFERENCE_PHRASES = ("can't stand", "cannot stand", "can't eat", "cannot eat")
NO_PREFERENCE = ("i'd like to", "i would like", "i love this approach", "i love this pr", "i love this idea", "i love this solution", "would love to", "would love feedback", "i hate to say", "i hate to admit")
# Words of queries that name no topic.
NO_TOPIC = (
    "a", "an", "the", "for", "on", "in", "of", "to", "and", "or", "i", "me", "my", "you", "your", "do", "is", "are", "some", "any", "can", "could", "would", "should", "what", "which", "how", "when", "where",
    "user", "preference", "like", "dislike", "use", "avoid", "likes", "dislikes", "uses", "avoids",
)
# Words that questions and answers share by chance, and verbs that answers have.
STOP_WORDS = (
    "the", "a", "an", "of", "in", "to", "for", "and", "or", "but", "at", "on", "by", "with", "is", "was", "are", "were", "be", "been", "he", "she", "it", "they", "we", "i", "his", "her", "its", "their", "our", "my",
    "what", "who", "when", "where", "why", "how", "does", "do", "did", "has", "have", "had", "that", "this", "which", "not", "no",
)
ANSWER_VERBS = (
    "is", "was", "are", "were", "has", "have", "had", "works", "worked", "lives", "lived", "prefers", "preferred", "uses", "used", "likes", "liked", "loves", "loved", "hates", "hated", "eats", "ate", "drives", "drove",
    "plays", "played", "enjoys", "enjoyed",
)


def _strings(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words))


def is_preference(query: Column) -> Column:
    return _says(query, PREFERENCE_QUERY)


def is_preference_content(text: Column) -> Column:
    """A text that states a preference, and none of the phrases that only sound like it."""
    low = F.lower(text)
    return ~contains_any(low, NO_PREFERENCE) & (_says(text, PREFERENCE_WORDS) | contains_any(low, PREFERENCE_PHRASES))


def stated_preferences(text: Column) -> Column:
    """The sentences of a text that state a preference, "I" at their start being the user."""
    parts = F.transform(F.split(text, r"[.!?\n]+"), lambda s: F.trim(s))
    mine = F.filter(parts, lambda s: (s != "") & is_preference_content(s))
    return F.transform(mine, lambda s: F.when(s.startswith("I "), F.concat(F.lit("User "), F.substr(s, F.lit(3)))).otherwise(s))


def topic_anchors(query: Column) -> Column:
    return F.array_except(token_set(query), _strings(NO_TOPIC))


def has_topic(text: Column, anchors: Column) -> Column:
    low = F.lower(text)
    return F.exists(anchors, lambda t: F.contains(low, t))


def name_pairs(query: Column) -> Column:
    """Neighbouring words that both begin with a capital letter, as "a b" in lower case, marks at their ends left out."""
    words = F.transform(F.filter(F.split(query, r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(w, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))
    some = F.size(words) > 1
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.struct(F.get(words, i - 1).alias("a"), F.get(words, i).alias("b")))
    named = F.filter(pairs, lambda p: p["a"].rlike("^[A-Z]") & p["b"].rlike("^[A-Z]"))
    return F.when(some, F.transform(named, lambda p: F.lower(F.concat_ws(" ", p["a"], p["b"])))).otherwise(F.array().cast("array<string>"))


def is_identifier(query: Column) -> Column:
    return query.rlike(URL) | query.rlike(PHONE) | (F.size(name_pairs(query)) > 0)


def identifier_hit(text: Column, query: Column) -> Column:
    """The text holds a URL or phone number of the query as it stands, or a pair of its names, in either order and any case."""
    exact = F.concat(F.regexp_extract_all(query, F.lit(URL), F.lit(0)), F.regexp_extract_all(query, F.lit(PHONE), F.lit(0)))
    low = F.lower(text)
    turned = lambda p: F.concat_ws(" ", F.get(F.split(p, " "), F.lit(1)), F.get(F.split(p, " "), F.lit(0)))
    return F.exists(exact, lambda x: F.contains(text, x)) | F.exists(name_pairs(query), lambda p: F.contains(low, p) | F.contains(low, turned(p)))


def without_controls(text: Column) -> Column:
    """Control characters but tab and line ends go."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")


def finite(x: Column) -> Column:
    """0 in place of what is not a number or infinite."""
    return F.when(F.isnan(x) | x.isin(float("inf"), float("-inf")), F.lit(0.0)).otherwise(x)


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, repeats included."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_hash(text: Column) -> Column:
    """The first half of the SHA-256 of the text in lower case, trimmed, white space collapsed."""
    return F.substring(F.sha2(F.regexp_replace(F.trim(F.lower(text)), r"\s+", " "), 256), 1, 32)


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; the text itself if it is shorter."""
    short = F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.array(text))
    return F.when(F.length(text) < 2, short).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substr(text, i, F.lit(2)))))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(both_empty)).otherwise(common / union)


def first_bytes(text: Column, most: int) -> Column:
    """The longest start of the text whose UTF-8 form has at most `most` bytes."""
    raw = F.encode(text, "UTF-8")
    inside = lambda k: F.hex(F.substring(raw, k + 1, 1)).rlike("^[89AB]")  # noqa: E731  byte k + 1 goes on with a character
    at = F.when(~inside(most), most).when(~inside(most - 1), most - 1).when(~inside(most - 2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(raw, F.lit(1), at), "UTF-8"))


def excerpt(text: Column, most: int = 500) -> Column:
    """The text, or, if its UTF-8 form has more than `most` bytes, what comes before the last character that begins within them, and an ellipsis."""
    raw = F.encode(text, "UTF-8")
    begins = lambda k: ~F.hex(F.substring(raw, k + 1, 1)).rlike("^[89AB]")
    at = F.when(begins(most), most).when(begins(most - 1), most - 1).when(begins(most - 2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.decode(F.substring(raw, F.lit(1), at), "UTF-8"), F.lit("…")))


def size_tier(text: Column) -> Column:
    n = F.octet_length(text)
    return F.when(n <= 500_000, "focused").when(n <= 8 << 20, "synopsis").when(n <= 50 << 20, "raw").otherwise("rejected")


def storage_mode(text: Column) -> Column:
    return F.when(F.octet_length(text) > 10_000, "document").otherwise("focused")


def is_operational_config(text: Column) -> Column:
    """At least two of the patterns of infrastructure settings occur."""
    return sum((F.coalesce(text.rlike(p), F.lit(False)).cast("int") for p in CONFIG_PATTERNS), F.lit(0)) >= 2


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found |= F.contains(text, F.lit(p))
    return found


def _says(query: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens(query), F.array(*map(F.lit, words)))


def is_temporal(query: Column) -> Column:
    return _says(query, TEMPORAL)


def is_update(query: Column) -> Column:
    return _says(query, UPDATE)


def is_aggregation(query: Column) -> Column:
    return ~query.rlike(TEMPORAL_QUANTITY) & (query.rlike(AGGREGATION) | query.rlike(MONETARY))


def exact_signals(query: Column) -> Column:
    """URLs, phone numbers and quoted phrases of a query, each once, in that order."""
    quoted = F.regexp_extract_all(query, F.lit('"([^"]+)"'), F.lit(1))
    return F.array_distinct(F.concat(F.regexp_extract_all(query, F.lit(URL), F.lit(0)), F.regexp_extract_all(query, F.lit(PHONE), F.lit(0)), quoted))


def date_of_tags(tags: Column) -> Column:
    """The first valid date of the tags date:YYYY-MM-DD, or YYYY/MM/DD with or without a weekday and time."""
    dates = F.transform(F.filter(tags, lambda t: t.startswith("date:")), lambda t: F.coalesce(F.try_to_date(F.substring(t, 6, 10), "yyyy-MM-dd"), F.try_to_date(F.substring(t, 6, 10), "yyyy/MM/dd")))
    return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))


def temporal_window(question: Column, day: Column) -> Column:
    """Struct (since, before) of dates that "yesterday" or "N units ago" mean, seen from day; null without such words.

    Months keep the day of the month, which runs over into the next month where that is shorter.
    """
    low = F.lower(F.trim(question))
    number = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
    found = rf"\b(\d+|{'|'.join(number)}) (days?|weeks?|months?|years?) ago\b"
    word, unit = F.regexp_extract(low, found, 1), F.regexp_extract(low, found, 2)
    named = F.element_at(F.create_map(*[F.lit(x) for pair in number.items() for x in pair]), word)
    n = F.coalesce(word.try_cast("int"), named)
    months = F.when(unit.startswith("month"), n).when(unit.startswith("year"), n * 12)
    back = F.date_add(F.add_months(F.trunc(day, "MM"), -months), F.dayofmonth(day) - 1)
    target = F.when(unit.startswith("day"), F.date_sub(day, n)).when(unit.startswith("week"), F.date_sub(day, n * 7)).otherwise(back)
    pad = F.when(unit.startswith("day"), 1).when(unit.startswith("week"), 3).when(unit.startswith("month"), 7).otherwise(30)
    ago = F.struct(F.date_sub(target, pad).alias("since"), F.date_add(target, pad + 1).alias("before"))
    yesterday = F.struct(F.date_sub(day, 1).alias("since"), day.alias("before"))
    return F.when(low.startswith("how many"), F.lit(None)).when(F.contains(low, F.lit("yesterday")), yesterday).when(word != "", ago)
