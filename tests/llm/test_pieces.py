"""What a worker keeps of the texts it has encoded."""

import pickle

import pyarrow as pa
import public_tokenizers

from skerry.llm import unigram
from skerry.llm.pieces import Memo


def test_every_copy_of_a_model_shares_one_memo():
    m = unigram.load_model(public_tokenizers.path("piece_bpe_32k.model"))
    for copy in (m, *(pickle.loads(pickle.dumps(m)) for _ in range(3))):
        ids, _ = unigram._ids_of(pa.array(["some words here"]), copy)
        assert ids.tolist() == unigram.encode_text(m, "some words here")
    assert len(unigram._memos) == 1


def test_a_memo_is_emptied_when_it_holds_many_ids():
    memo = Memo(lambda words: [[1] * 100 for _ in words], limit=1000, limit_ids=500)
    for lo in range(0, 100, 10):
        memo.slots([f"w{i}" for i in range(lo, lo + 10)])
    assert memo.used <= 2000 and len(memo.slot) <= 20
