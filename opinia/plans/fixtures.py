"""Small parameter tables used by the catalogue queries.

The reference takes its lexicon, stop words and lemmas from external
libraries; here they are input tables.  These in-line tables are demo
parameters chosen so that the invented prose in ``documents`` produces
non-empty results.  Every query still reads the whole input tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opinia.session import local_df

# Demo valence lexicon (word, valence).  Zero-valence words are
# included on purpose: they must be dropped as neutral.
DEMO_LEXICON = [
    ("best", 3.2), ("good", 1.9), ("great", 3.1), ("love", 3.2),
    ("excellent", 2.7), ("happy", 2.7), ("nice", 1.8), ("wonderful", 2.7),
    ("bad", -2.5), ("worst", -3.1), ("terrible", -2.1), ("awful", -2.0),
    ("hate", -2.7), ("poor", -2.1), ("worthless", -1.9), ("pathetic", -2.2),
    ("lying", -2.4), ("no", -1.2), ("disgusting", -2.4), ("idiot", -2.3),
    ("stupid", -2.4), ("the", 0.0), ("and", 0.0),
]

# Demo valence rules — boosters (word, increment) and negators.
DEMO_BOOSTERS = [("very", 0.293), ("really", 0.293), ("extremely", 0.293), ("barely", -0.293)]
DEMO_NEGATORS = ["not", "never", "no", "nor", "without"]

# Demo lemma / stem look-up (word, lemma).
DEMO_LEMMAS = [
    ("the", "the"), ("is", "be"), ("are", "be"), ("was", "be"), ("ores", "ore"),
    ("ing", "ing"), ("ed", "ed"), ("andes", "ande"), ("ings", "ing"), ("ers", "er"),
]


def lexicon_df(spark: SparkSession) -> DataFrame:
    return local_df(spark, DEMO_LEXICON, "word string, valence double")


def boosters_df(spark: SparkSession) -> DataFrame:
    return local_df(spark, DEMO_BOOSTERS, "word string, increment double")


def lemma_df(spark: SparkSession) -> DataFrame:
    return local_df(spark, DEMO_LEMMAS, "word string, lemma string")


def values_sql(rows, cols: str, alias: str = "t") -> str:
    """The same table as a DuckDB ``VALUES`` list for the oracle SQL."""
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(float(v)) if isinstance(v, float) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}({cols})"


def polarity_lexicon(spark: SparkSession) -> DataFrame:
    """Polarity in [-1, 1]: the demo valences divided by 4."""
    return local_df(spark, [(w, v / 4.0) for w, v in DEMO_LEXICON], "word string, polarity double")


POLARITY_ROWS = [(w, v / 4.0) for w, v in DEMO_LEXICON]


# The rating prompts (scale 1-9 for none and one example, 1-10 for
# two and five) and the translation prompt, word for word.
PROMPTS = {
    "zero_shot": """Give a rating from 1 to 9 for the following hotel review. Only answer with the number:
Review: "{comment}"
Rating:""",
    "one_shot": """Give a rating from 1 to 9 for the following hotel review. Only answer with the number.
Example 1:
Review: "We had a spledid time in the old centre of Porto. The appartment is very well situated next to the old Ribeira square. It's perfect to have such an appartment to your disposal, you feel home, and have a place to relax between the exploration of this very nice city. We thank Ana & Gonçalo, and we hope the appartment is free when we go back next year. Porto is charming original"
Rating: 9

Now, rate this review:
Review: "{comment}"
Rating:""",
    "two_shot": """Give a rating from 1 to 10 for the following hotel review. Only answer with the number.
Example 1:
Review: "We had a spledid time in the old centre of Porto. The appartment is very well situated next to the old Ribeira square. It's perfect to have such an appartment to your disposal, you feel home, and have a place to relax between the exploration of this very nice city. We thank Ana & Gonçalo, and we hope the appartment is free when we go back next year. Porto is charming original"
Rating: 9

Example 5:
Review :" It was our first time using Airbnb' and it was really good. Thanks for everything!"
Rating: 8

Now, rate this review:
Review: "{comment}"
Rating:""",
    "few_shot": """Give a rating from 1 to 10 for the following hotel review. Only answer with the number.
Example 1:
Review: "We had a spledid time in the old centre of Porto. The appartment is very well situated next to the old Ribeira square. It's perfect to have such an appartment to your disposal, you feel home, and have a place to relax between the exploration of this very nice city. We thank Ana & Gonçalo, and we hope the appartment is free when we go back next year. Porto is charming original"
Rating: 10

Example 2:
Review: "It's a nice flat. The location is good even though you have to walk a bit to the metro and quite a bit to the historic center. I liked that there was a restaurant in the same building."
Rating: 6

Example 3:
Review: "Great stay, would come back!"
Rating: 8

Example 4:
Review:  "The apartment was as we expected and I recommend it to other travelers."
Rating: 5

Example 5:
Review :" "The apartment was filthy, smelled terrible, and nothing worked. The bed was broken, there were bugs everywhere, and the host never responded to our messages. We left after the first night because it was impossible to stay there. Absolutely the worst experience I've ever had.""
Rating: 1

Now, rate this review:
Review: "{comment}"
Rating:""",
    "translate": """You are a professional translator. Respond with only the translation. Translate to informal English if not already English. Use straight apostrophes (') instead of curly ones (’).
Text: {comment}
Translation:""",
}
