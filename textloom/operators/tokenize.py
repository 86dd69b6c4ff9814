"""Tokens: literal special tokens first, then words or the pieces of a subword model; encoding of chat and preferences."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from textloom.functions import text as T

#: Special tokens of the chat format; fixed values.
SPECIAL = ("<|system|>", "<|user|>", "<|assistant|>", "</s>", "<s>", "<pad>", "<unk>", "<|citation|>")


def pieces(text: Column, special: Sequence[str] = SPECIAL) -> Column:
    """Special tokens, the longest first, wherever they stand, and the runs of other characters between them and white
    space. A special token's first character inside a word ends no word unless the whole token stands there."""
    longest = sorted(special, key=lambda s: (-len(s), s))
    literal = "|".join(map(T.literal_pattern, longest))
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{literal}|(?:(?!{literal})\\S)+"), F.lit(0))


def encode(text: Column, special: Sequence[str] = SPECIAL, begin: str | None = None, end: str | None = None) -> Column:
    """pieces, with a token before and after where they are given."""
    own = pieces(text, special)
    parts = [F.array(F.lit(begin))] * (begin is not None) + [own] + [F.array(F.lit(end))] * (end is not None)
    return F.concat(*parts) if len(parts) > 1 else own


def decode(tokens: Column, special: Sequence[str] = SPECIAL) -> Column:
    """The text of tokens without special ones."""
    return F.array_join(F.filter(tokens, lambda t: ~t.isin(*special)), " ")


def subword_encoder(path: str, special: Sequence[str] = SPECIAL):
    """A column function from text to ids by a trained model, a sentencepiece .model or a tokenizer .json; special tokens
    are cut out literally before the model sees the rest. The model is loaded once by each worker."""
    longest = sorted(special, key=lambda s: (-len(s), s))
    held: dict = {}

    def model():
        if "m" not in held:
            if path.endswith(".model"):
                import sentencepiece

                own = sentencepiece.SentencePieceProcessor(model_file=path)
                held["m"] = (own.encode, own.piece_to_id)
            else:
                from tokenizers import Tokenizer

                own = Tokenizer.from_file(path)
                held["m"] = (lambda t: own.encode(t, add_special_tokens=False).ids, own.token_to_id)
        return held["m"]

    @pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        import re

        cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")")
        run, number = model()
        known = {s: n for s in longest if (n := number(s)) is not None}

        def one(t: str | None) -> list[int]:
            out: list[int] = []
            for part in cut.split(t or ""):
                out += [known[part]] if part in known else run(part) if part else []
            return out

        return texts.map(one)

    return ids


def padded(tokens: Column, size: int, pad: str) -> Column:
    """The first size tokens, padded to size."""
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(pad), size)), 1, size)


def encode_preference(messages: Column, answer: Column, size: int, pad: str = "<pad>") -> Column:
    """The prompt, the mark of an answer, the answer and its end as tokens, cut and padded to size."""
    from textloom.operators.chat import render

    whole = F.concat(render(messages), F.lit("\n<|assistant|>\n"), T.strip(F.coalesce(answer, F.lit(""))), F.lit("\n</s>"))
    return padded(encode(whole, begin="<s>"), size, pad)
