import tracemalloc

import pyarrow as pa

from runline.llm.tokens import ids_of


def test_memory_of_a_batch():
    """Ids of many pieces take a few times the bytes of their texts, and are those of the texts one by one."""
    texts = [" ".join(f"w{(i * j) % 9973}x{j % 7}" for j in range(3000)) for i in range(1, 150)] + ["", None, " ", "a  b"]
    tokenizer, column = ids_of(), pa.array(texts)
    tracemalloc.start()
    ids, counts = tokenizer.batch(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [tokenizer.one(t or "") for t in texts]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert peak < 16 * column.nbytes
