"""Ids of texts that hold the names of special tokens, by the file's tokenizer as it is."""

import pyarrow as pa
from tokenizers import Tokenizer

from veilspark.llm import tokens

TEXTS = ["end <|endoftext|> next", "<|startoftext|>A b.<|endoftext|>", "x<|endoftext|>y z", "<|endoftext|><|endoftext|>", "  <|endoftext|>\n<|startoftext|>  tail",
         "<|ENDOFTEXT|> <|end oftext|> <| endoftext |>", "Été <|endoftext|>, it's\t<|startoftext|>", "plain words, no names"]


def test_ids_equal_the_untouched_tokenizers():
    whole = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    ids, bounds = tokens.load("word_bpe_49k").encode(pa.array(TEXTS))
    for i, text in enumerate(TEXTS):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids, text
    assert ids[:3].tolist() == [806, 49407, 1131]
