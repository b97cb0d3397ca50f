import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash

from kinspark.llm import bpe, language_id, media, page_text, simhash, sstable, toxicity

ALPHABET = " \n\t\r\x1c\x85 abcABC'sst123,.!éßÉ字😀́١ Σ¬"


def random_texts(n, seed=1, longest=40):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def test_bpe_as_the_library(encoder):
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.table.ranks, special_tokens={})
    texts = [*random_texts(3000), "", "ab" * 3000, "the quick brown fox " * 50]
    for text, ids in zip(texts, encoder.encode_many(texts), strict=True):
        assert memoryview(ids).cast("I").tolist() == theirs.encode_ordinary(text) if ids else text == ""
        assert encoder.decode(ids) == text.encode()


def test_segment_tree_side_by_side_equals_one_by_one(encoder):
    rng = random.Random(3)
    pieces = [bytes(rng.choices(b"abcdeth ing", k=rng.randint(1, 64))) for _ in range(500)]
    for piece, ids in zip(pieces, encoder.table.merge(pieces), strict=True):
        assert memoryview(ids).cast("I").tolist() == bpe.merge_piece(piece, encoder.table.ranks)


def test_word_encoder_as_the_library():
    own = sstable.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), 1)
    texts = random_texts(2000, 5)
    for ids, theirs in zip(own.encode_many(texts), own.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == [*theirs.ids, 1]


def test_shard_round_trip(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sstable, "BLOCK_BYTES", 200)
    rng = random.Random(2)
    rows = sorted([(rng.randint(-50, 50), np.array(rng.choices(range(60000), k=rng.randint(0, 40)), "<u2").tobytes()) for _ in range(300)], key=lambda r: r[0])
    path = str(tmp_path / "x.sst")
    with pa.OSFile(path, "wb") as out:
        writer = sstable.Writer(out, 2)
        for i, ids in [(None, b"\1\0"), *rows]:
            writer.add(sstable.key_of(i), ids)
        writer.close()
    with pa.OSFile(path) as source:
        reader = sstable.Reader(source)
        assert len(reader.index) > 5
        assert [(sstable.id_of(k), bytes(v)) for k, v in reader] == [(None, b"\1\0"), *rows]
        for i in range(-60, 60):
            assert reader.get(sstable.key_of(i)) == [v for k, v in rows if k == i]
        assert reader.get(b"") == [b"\1\0"]


def test_covering_masks():
    masks = simhash.covering_masks(4)
    rng = random.Random(4)
    assert len(masks) == 31
    for _ in range(3000):
        flips = sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4)))
        assert any(flips & m == 0 for m in masks)


def test_chunk_masks():
    rng = random.Random(9)
    for mask in simhash.covering_masks(4):
        parts = simhash.chunk_masks(mask, 4)
        assert mask | sum(parts) == (1 << 64) - 1 and mask & sum(parts) == 0
        free = [i for i in range(64) if not mask >> i & 1]
        for _ in range(50):
            flips = sum(1 << i for i in rng.sample(free, rng.randint(0, 4)))
            assert any(flips & p == 0 for p in parts)


def test_bloom_filter_in_blocks():
    from array import array

    hashed = array("Q", [sstable._hash(str(i).encode()) for i in range(3000)])
    bits = 3000 * sstable.BITS_PER_KEY
    made = sstable._bloom_filter(hashed, bits)
    there = lambda h: all(made[p >> 3] >> (p & 7) & 1 for p in sstable._bloom_places(h, bits, sstable.HASHES))
    assert all(map(there, hashed)) and sum(there(sstable._hash(f"no{i}".encode())) for i in range(3000)) < 100
    assert sstable.open_store("file:///tmp")[1] == "/tmp"


def test_fingerprint_by_counting():
    text = "The quick\tbrown fox JUMPS over\nthe lazy dog ünd more"
    words = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)


def test_star_links_keep_components():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(5)]
    members = np.array(sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 7))) for b in base for _ in range(40)}), np.uint64)

    def components(links):
        root = {int(m): int(m) for m in members}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(a)] = find(b)
        groups = {}
        for m in root:
            groups.setdefault(find(m), set()).add(m)
        return {frozenset(g) for g in groups.values()}

    every = [(int(a), int(b)) for a in members for b in members if a < b and (int(a) ^ int(b)).bit_count() <= 4]
    stars = [(int(a), int(b)) for a, others in simhash.star_links(members, 4) for b in others]
    assert components(every) == components(stars) and len(stars) < len(members)


def test_media():
    for text in (None, "", "x", "y" * 192, "ü" * 5000):
        payload, n = media.payload_of(text)
        assert len(payload) % 192 == 0 and len(payload) >= 192 and payload[:n].decode() == (text or "")
        back, rate = media.from_wav(media.to_wav(payload))
        assert back == payload
        (first, second), (third, fourth) = media.features(back, rate), media.features(payload, rate)
        assert (first == third).all() and second == fourth
    x = np.sin(np.arange(4001) / 9)
    for up, down in ((1, 2), (3, 2), (2, 3), (1, 1)):
        raised = np.zeros(len(x) * up)
        raised[::up] = x
        full = np.convolve(raised, media.low_pass(up, down, 32))[: len(raised)][::down]
        assert np.allclose(media.resample(x, up, down), full)
        assert np.allclose(media.resample(x, up, down, start=777, stop=1501), full[777:1501])
    assert media.active_spans(np.array([0.0] * 30 + [30.0] * 30 + [0.0] * 30)) != []


def test_frames_against_a_plain_transform(monkeypatch):
    """Each frame by sums over sines; the blocks it is made in change nothing."""
    rng = np.random.default_rng(1)
    samples = rng.integers(0, 256, 3001, np.uint8).tobytes()
    whole = np.concatenate(list(media.log_mel_blocks(samples, 16_000)))
    monkeypatch.setattr(media, "BLOCK_FRAMES", 3)
    assert np.allclose(np.concatenate(list(media.log_mel_blocks(samples, 16_000))), whole)
    x = np.frombuffer(samples, np.uint8).astype(float)
    y = media.resample((x - x.mean()) / 128)
    assert len(whole) == -(-(len(y) - media.WINDOW) // media.HOP) + 1
    n, mel = media.WINDOW, lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(mel(20), mel(4000), media.MELS + 2)]
    for at in (0, 5, len(whole) - 1):
        window = np.zeros(n)
        own = y[at * media.HOP :][:n]
        window[: len(own)] = own * [0.5 - 0.5 * np.cos(2 * np.pi * i / n) for i in range(len(own))]
        power = [abs(sum(window[i] * np.exp(-2j * np.pi * k * i / n) for i in range(n))) ** 2 for k in range(n // 2 + 1)]
        for band in range(media.MELS):
            low, mid, high = edges[band : band + 3]
            total = sum(p * max(0.0, min((k * 40 - low) / (mid - low), (high - k * 40) / (high - mid))) for k, p in enumerate(power))
            assert whole[at, band] == pytest.approx(np.log10(total + 1e-10), abs=1e-6)


def test_spans_against_a_plain_walk():
    rng = np.random.default_rng(2)
    for n in (1, 3, 8, 200):
        energy = np.repeat(rng.normal(0, 3, n), 4)[:n]
        width = min(media.SMOOTH, n)
        smooth = np.convolve(energy, np.full(width, 1 / width), "same")
        mean, on, want = smooth.mean(), False, []
        for i, v in enumerate(smooth):
            if not on and v > mean + media.ON_DB:
                on = True
                want.append([i, n])
            elif on and v < mean + media.OFF_DB:
                on, want[-1][1] = False, i
        assert media.active_spans(energy) == [tuple(x) for x in want]


def test_stored_tensors():
    import pyarrow as pa

    texts = ["", "x" * 3000, "ü y" * 9000, None]
    got = list(media.read_group(*media.store_group(pa.array([4, None, 2, 3]), texts)))
    assert [g[0].as_py() for g in got] == [4, None, 2, 3]
    for text, (_, n_bytes, wav, mel, spans, times) in zip(texts, got, strict=True):
        payload, n = media.payload_of(text)
        frames, active = media.features(payload, media.RATE)
        assert n == n_bytes and media.from_wav(wav) == (payload, media.RATE) and (mel == frames).all()
        assert spans == [media.seconds(a, b, media.RATE) for a, b in active] and sum(t[2] for t in times) == len(frames)
        assert times[0][0] == 0 and all(a < b for a, b, _ in times)


def _plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_shared_lines():
    rng = random.Random(6)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        shared = page_text.shared_lines(a, b)
        assert len(shared) == _plain_lcs(a, b)
        it = iter(b)
        assert all(x in it for x in (a[i] for i in sorted(shared)))


def test_read_lines():
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><a href='/x'>menu</a></nav><!-- c --><div class='ad'>buy</div><header>site</header>"
        "<article><h1>A &amp; B&am</h1><p>one <b>two</b>three<br>four<p>five<aside>side</aside><form>f</form><div class=comments>c</div><script>var a='</p>';</script></article><footer>&copy;</footer>"
    )
    assert page_text.read_lines(page)[0] == ["A & B&am", "one twothree", "four", "five"]
    assert page_text.read_lines(None) == ([], [], False) and page_text.read_lines("") == ([], [], False)
    inside, outside, marked = page_text.read_lines("<p>a</p><div>b<span>c</span></div>")
    assert (inside, outside, marked) == ([], ["a", "bc"], False)
    page_text.read_lines("<" * 5000 + "<a href='" + "x" * 1000)


def test_comments_and_names_of_elements():
    page = (
        "<main class='news with-sidebar'><article class='post'><p>Body</p><article class='comment'><p>reader says hi</p></article>"
        "<article><p>nested, so a reader's</p></article><p class=market>End</p></article><article class=userComment>x</article></main>"
        "<div class='advert1'>a</div><div class='topbar-menu2'>b</div><div class='siteNav'>c</div><div class='has-sidebar'>kept</div>"
    )
    assert page_text.read_lines(page) == (["Body", "End"], ["kept"], True)
    assert page_text.read_lines("<p data=it's>one</p><p title=\"a>b\">two</p>")[1] == ["one", "two"]


def test_hostile_pages_take_linear_time():
    import time

    began = time.process_time()
    for page in ("<a " * 300_000, '<a x=">" ' * 100_000, "<div>" * 100_000 + "</p>" * 100_000, "<p>same</p>" * 20_000, "<!--" * 200_000, "<" * 500_000):
        page_text.read_page(page)
    same, other = ["same"] * 3000 + ["x"] * 10, ["y"] + ["same"] * 3000 + ["z"]
    assert len(page_text.shared_lines(same, other)) == 3000
    assert time.process_time() - began < 10


def test_forward_backward_over_segments():
    rng = np.random.default_rng(0)
    t = rng.random((3, 3)).astype(np.float32) + 0.1
    potentials = rng.random((50, 3)).astype(np.float32) + 0.01
    lengths = np.array([1, 63, 64, 65, 200, 700])
    index = rng.integers(0, 50, lengths.sum())
    got, at = language_id.chain_sums(index, lengths, potentials, t), 0
    for n, sums in zip(lengths, got, strict=True):
        e = potentials[index[at : at + n]].astype(float)
        at += n
        a, b, alpha, beta = [], [None] * n, np.full(3, 1 / 3), np.full(3, 1 / 3)
        for s in range(n):
            alpha = (alpha @ t) * e[s]
            alpha /= alpha.sum()
            a.append(alpha)
        for s in range(n - 1, -1, -1):
            b[s] = beta
            beta = (beta * e[s]) @ t.T
            beta /= beta.sum()
        m = np.array(a) * np.array(b)
        assert np.allclose(sums, (m / m.sum(1, keepdims=True)).sum(0), rtol=1e-3)


def test_slopes_against_differences():
    """The training slopes are those of the log-likelihood, which is that of all label sequences enumerated."""
    import itertools

    rng = np.random.default_rng(3)
    scores, tr = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    index, gold = rng.integers(0, 5, (2, 4)), rng.integers(0, 3, (2, 4))
    there = np.ones((2, 4), bool)
    there[1, 3:] = False

    def plain(scores, tr):
        total = 0.0
        for own, labels, n in zip(index, gold, there.sum(1), strict=True):
            weight = lambda seq: np.exp(tr[:, seq[0]]).sum() / 3 * np.exp(sum(scores[own[i], c] for i, c in enumerate(seq)) + sum(tr[a, b] for a, b in itertools.pairwise(seq)))  # noqa: B023, E731
            total += np.log(weight(labels[:n]) / sum(weight(seq) for seq in itertools.product(range(3), repeat=int(n))))
        return total

    found, by_word, by_pair = language_id.slopes(scores, tr, index, there, gold)
    assert found == pytest.approx(plain(scores, tr))
    for values, own in ((scores, by_word), (tr, by_pair)):
        for at in np.ndindex(values.shape):
            kept, sides = values[at], []
            for d in (1e-5, -1e-5):
                values[at] = kept + d
                sides.append(plain(scores, tr))
            values[at] = kept
            assert own[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-5)


def test_signs_are_no_letters():
    assert [language_id.word_parts(x) for x in ("½", "①²", "a½b", "Ⅷ", "字", "12", "_x_")] == [[], [], ["ab"], [], ["字"], [], ["x"]]
    long = " ".join(f"w{chr(97 + i % 26) * (1 + i % 7)}" for i in range(5000))
    words = language_id.sampled_words(long).split()
    assert len(words) == language_id.SAMPLE_RUNS * language_id.MEAN_RUN and words[-1] == language_id.word_parts(long.split()[-1])[0]
    assert language_id.sampled_words("a b c") == "a b c"


def test_languages_and_switches():
    en, de = "the cat and the dog were with them in the house ", "der hund und die katze waren mit ihnen in dem haus "
    model = language_id.fit([en * 4] * 20 + [de * 4] * 20, ["en"] * 20 + ["de"] * 20)
    found = language_id.Predictor(model).predict([en, de, "", "123 !?", en * 3 + de, "x" * 500])
    assert [x for x, _ in found[:5]] == ["en", "de", "und", "und", "en"] and found[2][1] == 0 and 0 <= found[5][1] <= 1


def test_toxicity_learns_words_and_stems():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(300)]
    texts, labels = [], []
    for i in range(600):
        words = rng.choices(vocabulary, k=30)
        if i % 6 == 0:
            words.insert(9, "zorgle" if i % 12 else "quibb" + rng.choice("abcdefg") * 2)
        texts.append(" ".join(words))
        labels.append(int(i % 6 == 0))
    score = toxicity.fit(texts, labels).scorer()
    clean = " ".join(rng.choices(vocabulary, k=30))
    assert score(clean) < 0.3 and score("") < 0.3 and score(f"{clean} zorgle, {clean}") >= 0.3 and score(f"{clean} QUIBBxyz!") >= 0.3
    assert toxicity.fit(["idiot", "fine"], [0, 0]).scorer()("you idiot") >= 0.3


def test_label_model_against_enumeration():
    """With the tree's rates, the chances of all vote vectors sum to 1 in each class, and log-odds are their ratio."""
    import itertools

    rng = np.random.default_rng(5)
    votes = (rng.random((200, 5)) < 0.4).astype(np.float32)
    votes[:, 3] = np.where(rng.random(200) < 0.9, votes[:, 1], votes[:, 3])
    q = rng.random(200)
    parent = toxicity.dependency_tree(votes, q)
    assert (parent[3] == 1 or parent[1] == 3) and (parent == -1).sum() >= 1
    rates = toxicity.vote_rates(votes, q, parent)
    every = np.array(list(itertools.product((0, 1), repeat=5)), np.float32)

    def chance(row, label):
        out = 1.0
        for i, v in enumerate(row):
            r = rates[label, int(row[parent[i]]) if parent[i] >= 0 else 0, i]
            out *= r if v else 1 - r
        return out

    assert [sum(chance(r, c) for r in every) for c in (0, 1)] == pytest.approx([1, 1])
    assert np.allclose(toxicity.log_odds(every, rates, parent), [np.log(chance(r, 1) / chance(r, 0)) for r in every], atol=1e-4)


def test_voters_overrule_wrong_labels():
    rng = np.random.default_rng(6)
    truth = rng.random(3000) < 0.3
    votes = np.stack([np.where(truth, rng.random(3000) < 0.7, rng.random(3000) < 0.03) for _ in range(6)], 1).astype(np.float32)
    wrong = rng.random(3000) < 0.15
    q, rates, discounts, _, rights = toxicity.label_model(votes, np.where(wrong, ~truth, truth).astype(int), 0.34)
    assert ((q > 0.5) == truth)[wrong].mean() > 0.9 and ((q > 0.5) == truth).mean() > 0.97
    assert rights[1] == pytest.approx(0.85, abs=0.04) and rights[0] == pytest.approx(0.15, abs=0.04)
    assert np.allclose(rates[1], 0.7, atol=0.05) and np.allclose(rates[0], 0.03, atol=0.03)
    twice = np.hstack([votes, votes[:, :1]])
    assert toxicity.label_model(twice, truth.astype(int), 0.3)[2][0] < 0.6 < discounts.min()


def test_logistic_is_at_its_best():
    rng = np.random.default_rng(7)
    x, q, centre = (rng.random((300, 4)) < 0.3).astype(float), rng.random(300), np.array([1.0, -2, 0, 3])
    w = toxicity.logistic(x, q, centre)
    z = x @ w[:-1] + w[-1]
    slope = x.T @ (q - 1 / (1 + np.exp(-z))) - 0.3 * (w[:-1] - centre)
    assert np.abs(slope).max() < 1e-3


def test_toxic_words_without_spaces():
    rng = random.Random(3)
    signs = "天地人山水火木金土日月星风云雨雪"
    texts = ["".join(rng.choices(signs, k=40)) for _ in range(400)]
    for i in range(0, 400, 5):
        texts[i] = texts[i][:13] + "混蛋" + texts[i][13:]
    score = toxicity.fit(texts, [int(i % 5 == 0) for i in range(400)]).scorer()
    assert score("天地人混蛋山水") >= 0.3 > score("天地人山水")


def test_units_are_counted_in_little_memory():
    rng = np.random.default_rng(5)
    vocabulary = [f"{'bad' if i < 6 else 'w'}{i:05d}x" for i in range(3000)]
    toxic = (np.arange(900) % 3 == 0).astype(np.int64)
    words = [np.unique(np.concatenate([rng.integers(6, 3000, 400), rng.integers(0, 6, 2 * t)])) for t in toxic.tolist()]
    row_of, word_of = np.repeat(np.arange(900, dtype=np.int32), [len(w) for w in words]), np.concatenate(words).astype(np.int32)
    tracemalloc.start()
    names, rows, at = toxicity.choose_units(row_of, word_of, pa.array(vocabulary), toxic)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * len(row_of)
    assert "=bad00002x" in names
    for i, unit in enumerate(names):
        held = [r for r, own in enumerate(words) if any(unit in toxicity.units_of(vocabulary[w]) for w in own if w < 6)]
        assert rows[at == i].tolist() == held
