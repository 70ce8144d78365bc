from pairloom.functions.text import (  # noqa: F401
    change_ratio,
    hash_key,
    word_count,
    word_edit_distance,
    words,
)
