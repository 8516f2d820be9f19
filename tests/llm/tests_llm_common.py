DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def random_text(rng, n, vocab=4000):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))
