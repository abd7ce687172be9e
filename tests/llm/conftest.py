import os

import pytest

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="session")
def encoder():
    if not os.path.exists(TOKENIZER):
        pytest.skip("no vocabulary")
    from grainmill.llm.encode import Encoder

    return Encoder(TOKENIZER)


GRANT = "seq long, grant_id string, title string, description string, source_url string, source_name string, deadline string, eligibility string, status string, last_verified timestamp_ntz, locations array<string>, industries array<string>, raw_data string"
