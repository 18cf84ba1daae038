import random

import pyarrow as pa

from tessera.llm.common import ALNUM_TABLE, alnum_split, blanked, token_codes


def test_token_codes_split_like_python():
    rng = random.Random(1)
    plain = blanked(bytes(range(256)))
    for _ in range(200):
        texts = [bytes(rng.choice(b"ab \n\x0b\x1f\x85\xc3\xa9Z9") for _ in range(rng.choice([0, 0, 1, 5, 40]))) for _ in range(rng.randint(0, 6))]
        whole = pa.array([b"skipped", *texts], pa.binary())
        for array in (pa.array(texts, pa.binary()), whole.slice(1)):
            for table, split in ((plain, bytes.split), (ALNUM_TABLE, alnum_split)):
                code, sizes, words = token_codes(array, table)
                want = [split(t) for t in texts]
                assert sizes.tolist() == [len(w) for w in want]
                assert [words[int(c)].as_py() for c in code] == [x for w in want for x in w]
                assert len(set(words.to_pylist())) == len(words)
