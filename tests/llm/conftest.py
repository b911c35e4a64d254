import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Invented prose: ``prose(words, seed)``."""

    def build(words, seed=0):
        source = random.Random(seed)
        parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "it"]
        return " ".join("".join(source.choice(parts) for _ in range(source.randint(1, 4))) for _ in range(words))

    return build
