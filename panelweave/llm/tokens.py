"""Token counts of a BPE piece model through whole-token shortcuts.

Offline, once per worker, every vocabulary string of the form space + text is encoded alone; those that
come out as one token form the shortcut table. A text is cut before every space that follows a non-space.
The cut is safe when no vocabulary piece holds a space after a non-space (proved from the vocabulary at
load): merges then never cross it, and the count of the text is the sum over its pre-tokens. A pre-token
in the table counts one; only the rest are merged, each distinct one once per worker while it is
remembered. A vocabulary without that property is encoded text by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import CACHE_ENTRIES, pick, worker_store

SPACE = "▁"
LIMIT = 4096
BATCH = 512
_PRE_TOKEN = re.compile(" +[^ ]*|[^ ]+")


class PieceCounter:
    """Counts tokens of whole texts as the sentencepiece library gives them."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())
                  if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        probe = "a  b "
        self.separable = (
            not any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in pieces)
            # spaces stay as they are and one is put in front: the normaliser changes nothing else
            and self.model.decode(self.model.encode(probe)) == probe and self.model.encode("a", out_type=str)[0].startswith(SPACE))
        starts = [piece[1:] for piece in pieces if len(piece) > 1 and piece[0] == SPACE and SPACE not in piece[1:]]
        counts = map(len, self.model.encode(starts, num_threads=1))
        self.whole = {word: 1 for word, n in zip(starts, counts) if n == 1}
        self.whole[""] = len(self.model.encode("a ")) - len(self.model.encode("a"))  # a space before a space or the end
        self.merged: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        if not self.separable:
            return [len(ids) for ids in self.model.encode(texts, num_threads=1)]
        whole, known = self.whole, self.merged
        if len(known) > CACHE_ENTRIES:
            known.clear()
        lengths, rests = [], []
        for text in texts:
            plain = text.replace(SPACE, " ")
            if "  " in plain or plain[:1] == " " or plain[-1:] == " ":
                # a run of spaces: all but its last belong to the same pre-token
                words = [token[1:] for token in _PRE_TOKEN.findall(" " + plain)]
            else:
                words = plain.split(" ") if plain else []
            rest = [word for word in words if word not in whole]
            blank = words.count("") if "" in words else 0
            lengths.append(len(words) - len(rest) + blank * (whole[""] - 1))
            rests.append(rest)
        missing = list({word for rest in rests for word in rest if word not in known})
        fresh = dict(zip(missing, map(len, self.model.encode(missing, num_threads=1)))) if missing else {}
        known.update((k, v) for k, v in fresh.items() if len(k) <= 64)
        return [n + sum([fresh[w] if (k := known.get(w)) is None else k for w in rest]) for n, rest in zip(lengths, rests)]


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. One pass, no shuffle.

    Null and empty texts have no bytes and no tokens. Texts of any length are counted whole. Repeated rows,
    null ids and extra columns are kept apart or ignored; an empty table gives an empty result.
    """
    source = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_store(f"pieces:{model_file}", lambda: PieceCounter(model_file))
        for batch in batches:
            text = batch.column("text")
            values = text.to_pylist()
            counts = [n for i in range(0, len(values), BATCH) for n in counter.count(values[i:i + BATCH])]
            sizes = pa.array([len(value) for value in text.cast(pa.binary()).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(counts, pa.int64()),
                                              pa.array(np.array(counts, np.int64) > limit)],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
