"""Tables and a tokenizer for the tests."""

import functools

import public_tokenizers
from tokenizers import Tokenizer


def load(spark, sf, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*columns).collect()]


@functools.cache
def tokenizer(special_as_text=False):
    """The tokenizer as its file has it; its special tokens may be taken as ordinary text."""
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = special_as_text
    return made


#: Texts with nothing, white space only, ties, odd characters, and one that is very long.
TEXTS = [
    None,
    "",
    " ",
    " \n\t\n",
    "word",
    "a b c d e",
    "A  B\tC\x0bD e\n",
    "The same long line here\nand another one\nThe same long line here",
    "the SAME long line here  \n  short\nx",
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen",
    "One, two three-four five six seven eight nine ten eleven twelve thirteen! fourteen",
    "é́ ñ 日本語 テキスト 👍🏽 <|im_end|> &amp; &lt;| <b> # $ %",
    "\x00\x1c\x1f nul and　wide  spaces\r\nx",
    " ".join(f"w{k % 997}" for k in range(60_000)),
    "again and again " * 500,
]

CLASHING = "kept string, n_words long, _id string, score string, ids string, `set` string, node string"


def edge_documents(spark, texts=TEXTS):
    """Each text twice: under two ids, the second row repeated; columns that clash with results."""
    rows = []
    for k, text in enumerate(texts):
        rows += [(2 * k, text), (2 * k + 1, text), (2 * k + 1, text)]
    extra = ("k", -1, "i", "s", "x", "y", "z")
    schema = f"doc_id long, text string, {CLASHING}"
    return spark.createDataFrame([(*r, *extra) for r in rows], schema), rows


def no_documents(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {CLASHING}")
