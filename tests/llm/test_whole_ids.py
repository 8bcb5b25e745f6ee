"""Ids around underscores against the tokenizers library."""

import numpy as np
import pytest

from twinlake.llm.registry import vocabulary
from twinlake.llm.tokens import ChunkIds, load


@pytest.mark.parametrize("text", ["foo_. bar", "_word_, next", "a_, b_. c_.", "end_."])
def test_ids_of_underscores_before_signs(text):
    assert np.frombuffer(ChunkIds(vocabulary()).of([text])[0], "<u4").tolist() == load(vocabulary()).encode(text, add_special_tokens=False).ids
