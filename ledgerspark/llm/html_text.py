"""Main text of web pages: a recurrent network labels every block of a page.

``html_blocks`` cuts a page into leaf blocks.  A block's input is the mean of the vectors of its
tag path (tags, words of class, id and role, hashed), the mean of the vectors of its words
(hashed), and four numbers.  A bidirectional LSTM in numpy reads the blocks of the whole page, so
a block is judged by what stands before and after it, however far; blocks whose probability
reaches ``KEEP`` are the main text.

Training needs no labelled table.  ``sample`` different pages are taken (those with the smallest
hash, the bound of the sample); those that mark their article give labels directly, and
their paragraphs fill ``MADE`` pages of made layouts: menus, headers, footers, sidebars, notices,
adverts, forms and reader comments around an article, with semantic elements, with telling class
names, or with neither.  The network learns these labels by gradient descent in the driver.

Defined cases: a null or empty page, or one without text, has an empty text; a null id or url is
kept; rows that repeat an id are pages of their own; an empty table gives no rows; very long pages
are read whole (a page is decoded by one task, and its memory grows with the page); other columns
are ignored, whatever their names; without any page to learn from the article element decides.
"""

from __future__ import annotations

import pickle
import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import slices
from ledgerspark.llm.html_blocks import Block, blocks

SAMPLE = 240
MADE = 400
SEED = 5
EPOCHS = 10
RATE = 0.01
BATCH = 24
KEEP = 0.5
PATH_BUCKETS, WORD_BUCKETS = 2048, 4096
PATH_DIM, WORD_DIM, HIDDEN = 20, 8, 20
NUMBERS = 4
# words whose bucket a worker keeps
KNOWN_WORDS = 1 << 18

# --- fixed values: what elements around an article are called and say --------------------------

KINDS = {
    "menu": ("nav div ul", "nav menu navigation navbar breadcrumb topbar"),
    "header": ("header div", "header masthead site banner logo top"),
    "footer": ("footer div", "footer colophon copyright bottom legal"),
    "sidebar": ("aside div section", "sidebar widget related recommended popular trending rail aside"),
    "notice": ("div section dialog", "cookie consent notice alert popup modal newsletter subscribe privacy gdpr"),
    "advert": ("div aside section", "ad ads advert advertisement sponsored promo sponsor adsense"),
    "form": ("form", "form search login signup contact subscribe"),
    "comments": ("section div ol", "comments comment discussion responses replies disqus feedback"),
    "share": ("div ul", "share social sharing follow"),
}
ARTICLE = ("article main div section", "article content post entry story main body text")
NEUTRAL = "wrap container inner block col box row page left right js"
PHRASES = {
    "menu": "Home About Contact News Products Login Start Impressum Kontakt Accueil Contactez Inicio Contacto Sitemap Help Blog",
    "header": "Daily Times|Welcome to our site|The Gazette|Willkommen|Bienvenue|Your trusted source|Sign in|Skip to content",
    "footer": "All rights reserved|© 2024|© Copyright|Terms of use|Privacy policy|Alle Rechte vorbehalten|Tous droits réservés|"
    "Todos los derechos reservados|Powered by|Imprint",
    "sidebar": "Related articles|Most read|Read more|You may also like|Popular posts|Latest news|Tags|Archive|Recommended",
    "notice": "We use cookies to improve your experience|Accept all cookies|This site uses cookies|Subscribe to our newsletter|"
    "Wir verwenden Cookies|Nous utilisons des cookies|Usamos cookies|Manage preferences|Your browser is out of date",
    "advert": "Advertisement|Sponsored|Buy now|Special offer|Limited time only|Anzeige|Publicité|Publicidad|Free shipping today",
    "form": "Your name|Email address|Password|Search|Send message|Sign up now|Log in|Forgot your password?|Message|Phone",
    "comments": "Comments|Leave a reply|Reply|Great post, thanks!|I disagree with this|3 days ago|Posted by|Report abuse|Load more comments",
    "share": "Share|Tweet|Share on Facebook|Print|Email this|Follow us",
}
BOILER = frozenset(w for _, names in KINDS.values() for w in names.split()) - {"site", "top", "banner"}


# --- features ---------------------------------------------------------------------------------


@dataclass
class Page:
    """Inputs of a page's blocks: hashed paths and words with list starts, and the numbers."""

    paths: np.ndarray
    path_at: np.ndarray
    words: np.ndarray
    word_at: np.ndarray
    numbers: np.ndarray

    def __len__(self) -> int:
        return len(self.numbers)


_known: dict[str, int] = {}


def _bucket(word: str) -> int:
    found = _known.get(word)
    if found is None:
        found = 1 + zlib.crc32(word.encode("utf-8", "surrogatepass")) % (WORD_BUCKETS - 1)
        if len(_known) < KNOWN_WORDS:
            _known[word] = found
    return found


def features(found: list[Block]) -> Page:
    paths, words, numbers = [], [], []
    path_at, word_at = [0], [0]
    for i, b in enumerate(found):
        own = b.text.lower().split()
        # entry 0 keeps every list non-empty
        paths += [0, *(1 + zlib.crc32(p.encode()) % (PATH_BUCKETS - 1) for p in b.path)]
        words += [0, *map(_bucket, own)]
        path_at.append(len(paths))
        word_at.append(len(words))
        numbers.append((np.log1p(len(own)) / 5, b.link, float(b.text[-1] in ".!?…:;\"'»"), 1 / (1 + i)))
    return Page(np.array(paths), np.array(path_at[:-1]), np.array(words), np.array(word_at[:-1]), np.array(numbers, np.float32))


def _mean(table: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(np.append(at, len(ids))).astype(np.float32)
    return np.add.reduceat(table[ids], at) / sizes[:, None], sizes


# --- the network ------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one in page order and one against it, under one logistic output."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        wide = PATH_DIM + WORD_DIM + NUMBERS

        def table(*shape: int, scale: float) -> np.ndarray:
            return (rng.normal(size=shape) * scale).astype(np.float32)

        self.p = {"path": table(PATH_BUCKETS, PATH_DIM, scale=0.3), "word": table(WORD_BUCKETS, WORD_DIM, scale=0.1)}
        for way in "fb":
            self.p |= {
                f"w{way}": table(wide, 4 * HIDDEN, scale=wide**-0.5), f"u{way}": table(HIDDEN, 4 * HIDDEN, scale=HIDDEN**-0.5),
                f"c{way}": np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN),
            }
        self.p |= {"out": table(2 * HIDDEN + wide, 1, scale=0.1), "bias": np.zeros(1, np.float32)}

    def _inputs(self, page: Page) -> np.ndarray:
        return np.concatenate([_mean(self.p["path"], page.paths, page.path_at)[0], _mean(self.p["word"], page.words, page.word_at)[0], page.numbers], 1)

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States of one direction, ``(time, pages, HIDDEN)``; a masked step keeps its state."""
        steps, pages, _ = x.shape
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        z_in = x @ self.p[f"w{way}"] + self.p[f"c{way}"]
        states, kept = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps):
            z = z_in[t] + h @ self.p[f"u{way}"]
            gates = _sigmoid(z)
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN : 3 * HIDDEN]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new_c = f * c + i * g
            tanh_c = np.tanh(new_c)
            m = mask[t][:, None]
            if keep:
                kept.append((h, c, i, f, o, g, tanh_c))
            c = m * new_c + (1 - m) * c
            h = m * (o * tanh_c) + (1 - m) * h
            states[t] = h
        return states, kept

    def _back(self, way: str, x: np.ndarray, mask: np.ndarray, kept: list, d_states: np.ndarray, grads: dict) -> np.ndarray:
        u = self.p[f"u{way}"]
        dh, dc = np.zeros_like(d_states[0]), np.zeros_like(d_states[0])
        d_x = np.zeros_like(x)
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, o, g, tanh_c = kept[t]
            m = mask[t][:, None]
            dh = dh + d_states[t]
            d_new = m * (dc + dh * o * (1 - tanh_c**2))
            dz = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), m * dh * tanh_c * o * (1 - o), d_new * i * (1 - g**2)], 1)
            grads[f"w{way}"] += x[t].T @ dz
            grads[f"u{way}"] += h.T @ dz
            grads[f"c{way}"] += dz.sum(0)
            d_x[t] = dz @ self.p[f"w{way}"].T
            dc = d_new * f + (1 - m) * dc
            dh = dz @ u.T + (1 - m) * dh
        return d_x

    def _padded(self, pages: list[Page]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Inputs in page order with a mask, and for each page the way back to front."""
        steps = max(map(len, pages))
        x = np.zeros((steps, len(pages), PATH_DIM + WORD_DIM + NUMBERS), np.float32)
        mask = np.zeros((steps, len(pages)), np.float32)
        for k, page in enumerate(pages):
            x[: len(page), k] = self._inputs(page)
            mask[: len(page), k] = 1
        turned = [np.r_[np.arange(len(p) - 1, -1, -1), np.arange(len(p), steps)] for p in pages]
        return x, mask, turned

    @staticmethod
    def _turn(x: np.ndarray, turned: list[np.ndarray]) -> np.ndarray:
        return np.stack([x[order, k] for k, order in enumerate(turned)], 1)

    def probabilities(self, pages: list[Page]) -> list[np.ndarray]:
        """For each page, how likely each block belongs to the main text."""
        x, mask, turned = self._padded(pages)
        ahead, _ = self._run("f", x, mask)
        back, _ = self._run("b", self._turn(x, turned), mask)
        z = np.concatenate([ahead, self._turn(back, turned), x], 2) @ self.p["out"] + self.p["bias"]
        return [_sigmoid(z[: len(p), k, 0]) for k, p in enumerate(pages)]

    def gradients(self, pages: list[Page], labels: list[np.ndarray]) -> tuple[float, dict]:
        """Mean log loss over the blocks and its gradients."""
        x, mask, turned = self._padded(pages)
        ahead, kept_f = self._run("f", x, mask, keep=True)
        x_b = self._turn(x, turned)
        back, kept_b = self._run("b", x_b, mask, keep=True)
        top = np.concatenate([ahead, self._turn(back, turned), x], 2)
        prob = _sigmoid(top @ self.p["out"] + self.p["bias"])[:, :, 0]
        target = np.zeros_like(mask)
        for k, own in enumerate(labels):
            target[: len(own), k] = own
        n = mask.sum()
        loss = -float((mask * np.log(np.where(target > 0, prob, 1 - prob) + 1e-9)).sum() / n)
        dz = (mask * (prob - target) / n)[:, :, None]
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["out"] = np.einsum("tbi,tbj->ij", top, dz)
        grads["bias"] = dz.sum((0, 1))
        d_top = dz @ self.p["out"].T
        d_x = d_top[:, :, 2 * HIDDEN :].copy()
        d_x += self._back("f", x, mask, kept_f, d_top[:, :, :HIDDEN], grads)
        d_x += self._turn(self._back("b", x_b, mask, kept_b, self._turn(d_top[:, :, HIDDEN : 2 * HIDDEN], turned), grads), turned)
        for k, page in enumerate(pages):
            own = d_x[: len(page), k]
            for name, ids, at, lo, hi in (("path", page.paths, page.path_at, 0, PATH_DIM), ("word", page.words, page.word_at, PATH_DIM, PATH_DIM + WORD_DIM)):
                sizes = np.diff(np.append(at, len(ids)))
                np.add.at(grads[name], ids, np.repeat(own[:, lo:hi] / sizes[:, None], sizes, 0))
        return loss, grads

    def fit(self, pages: list[Page], labels: list[np.ndarray], seed: int, epochs: int = EPOCHS, rate: float = RATE) -> float:
        """Adam over batches of pages of similar length; returns the last epoch's mean loss."""
        rng = random.Random(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, losses = 0, []
        by_length = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        batches = [by_length[i : i + BATCH] for i in range(0, len(by_length), BATCH)]
        for epoch in range(epochs):
            rng.shuffle(batches)
            losses = []
            for batch in batches:
                loss, grads = self.gradients([pages[i] for i in batch], [labels[i] for i in batch])
                losses.append(loss)
                step += 1
                size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                shrink = min(1.0, 1.0 / max(size, 1e-9))
                now = rate * (0.5 if epoch > epochs * 0.6 else 1)
                for k, g in grads.items():
                    first[k] += 0.1 * (g * shrink - first[k])
                    second[k] += 0.01 * ((g * shrink) ** 2 - second[k])
                    self.p[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses)) if losses else 0.0


# --- training pages ---------------------------------------------------------------------------


def marked(found: list[Block]) -> np.ndarray | None:
    """Labels of a page that marks its article, else None."""
    def inside(b: Block) -> bool:
        tags = {p.rstrip(".") for p in b.path}
        return bool(tags & {"article", "main"}) and not tags & BOILER and not tags & {"nav", "footer", "aside", "form", "hidden"}

    labels = np.array([inside(b) for b in found], np.float32)
    return labels if labels.any() else None


class PageMaker:
    """Pages of random layouts whose blocks carry their label in ``data-kept``."""

    def __init__(self, prose: list[str], seed: int):
        self.rng, self.prose = random.Random(seed), prose or ["Some words of a text that goes on."]
        self.words = [w for t in self.prose for w in t.split()]

    def _text(self) -> str:
        return self._escape(self.rng.choice(self.prose))

    @staticmethod
    def _escape(text: str) -> str:
        return text.replace("&", "&amp;").replace("<", "&lt;")

    def _few(self, most: int = 4) -> str:
        return self._escape(" ".join(self.rng.choices(self.words, k=self.rng.randint(1, most))))

    def _named(self, tags: str, names: str, kept: int, telling: float) -> tuple[str, str]:
        """A start and an end tag; with the chance ``telling`` the names say what it is."""
        rng = self.rng
        tag = rng.choice(tags.split())
        own = rng.sample(names.split(), rng.randint(1, 2)) if rng.random() < telling else []
        own += rng.sample(NEUTRAL.split(), rng.randint(0, 1))
        if not own or (rng.random() < 0.2 and tag not in ("div", "section", "ul", "ol")):
            return f'<{tag} data-kept="{kept}">', f"</{tag}>"
        attr = rng.choice(["class", "class", "class", "id"])
        return f'<{tag} {attr}="{rng.choice(["-", " ", "_"]).join(own)}" data-kept="{kept}">', f"</{tag}>"

    def _phrase(self, kind: str) -> str:
        known = PHRASES[kind]
        return self.rng.choice(known.split("|") if "|" in known else known.split())

    def _boiler(self, kind: str) -> str:
        rng = self.rng
        start, end = self._named(*KINDS[kind], 0, 1.0 if kind in ("advert", "notice", "comments", "sidebar") else 0.75)
        if kind in ("menu", "share") or (kind in ("sidebar", "footer") and rng.random() < 0.5):
            items = [f'<li><a href="/x">{self._phrase(kind) if rng.random() < 0.5 else self._few(3)}</a></li>' for _ in range(rng.randint(2, 8))]
            inner = "".join(items)
            inner = inner if "<ul" in start or "<ol" in start else f"<ul>{inner}</ul>"
            if kind == "sidebar":
                inner = f"<h3>{self._phrase(kind)}</h3>{inner}"
        elif kind == "form":
            inner = "".join(f"<label>{self._phrase(kind)}</label><input><p>{self._few(6)}</p>" for _ in range(rng.randint(1, 3)))
        elif kind == "comments":
            one = rng.choice(["<div class=comment><p>{}</p></div>", "<article class=comment><p>{}</p></article>", "<li><p>{}</p></li>", "<p>{}</p>"])
            inner = f"<h3>{self._phrase(kind)}</h3>" + "".join(
                one.format(self._text() if rng.random() < 0.6 else self._phrase(kind)) for _ in range(rng.randint(1, 5))
            )
        else:
            said = [self._text() if rng.random() < 0.5 else self._phrase(kind) + " " + self._few(8) for _ in range(rng.randint(1, 2))]
            inner = "".join(f"<p>{s}</p>" if rng.random() < 0.5 else s + " " for s in said)
            if kind == "header" and rng.random() < 0.5:
                inner = f"<h1>{self._few(5)}</h1>" if rng.random() < 0.5 else f"<div>{inner}</div>"
        return start + inner + end

    def _article(self) -> str:
        rng = self.rng
        start, end = self._named(*ARTICLE, 1, 0.7)
        parts = []
        if rng.random() < 0.8:
            title = f"<h1>{self._few(12)}</h1>"
            parts.append(f"<header>{title}</header>" if rng.random() < 0.15 else title)
        for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 14, 25])):
            kind = rng.random()
            if kind < 0.68:
                text = self._text()
                # paragraphs without an end, bold text that stays open
                parts.append(rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>"]).format(text))
            elif kind < 0.74:
                parts.append(f"<h2>{self._few(8)}</h2>")
            elif kind < 0.8:
                parts.append("<ul>" + "".join(f"<li>{self._few(15)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.84:
                parts.append(f"<blockquote><p>{self._text()}</p></blockquote>")
            elif kind < 0.94:
                # short lines, some of them repeated
                parts += [f"<p>{self._few(2)}.</p>"] * rng.choice([1, 1, 1, 2, 8])
            else:
                parts.append(self._boiler(rng.choice(["advert", "share", "sidebar", "notice"])))
        return start + "".join(parts) + (end if rng.random() < 0.93 else "")

    def page(self) -> str:
        rng = self.rng
        before = [k for k in ("notice", "header", "menu", "form", "advert", "sidebar", "share") if rng.random() < 0.4]
        after = [k for k in ("share", "advert", "comments", "sidebar", "form", "notice", "menu") if rng.random() < 0.3]
        rng.shuffle(before)
        after += ["footer"] if rng.random() < 0.8 else []
        if rng.random() < 0.3:
            rng.shuffle(after)
        wrap = rng.choice([("", ""), ("<main>", "</main>"), ('<div class="container">', "</div>"), ('<div id="page">', "</div>")])
        body = "".join(map(self._boiler, before)) + wrap[0] + self._article()
        rest = "".join(map(self._boiler, after))
        rest = wrap[1] + rest if rng.random() < 0.7 else rest + wrap[1]
        return f"<html><head><title>{self._few()}</title></head><body>{body}{rest}</body></html>"


def train(pages: DataFrame, sample: int = SAMPLE, made: int = MADE, seed: int = SEED) -> Labeller | None:
    """Fit the labeller on at most ``sample`` pages and ``made`` made ones."""
    keyed = pages.where("html is not null").select(F.xxhash64(F.lit(seed), "page_id", "html").alias("key"), "html")
    # keys first: no task sends pages that are not chosen, and equal rows count once
    keys = [r["key"] for r in keyed.groupBy("key").agg(F.lit(1)).orderBy("key").limit(sample).collect()]
    rows = keyed.where(F.col("key").isin(keys)).groupBy("key").agg(F.min("html").alias("html")).orderBy("key").collect() if keys else []
    read = [found for r in rows if (found := list(blocks(r["html"])))]
    if not read:
        return None
    labelled = [(found, own) for found in read if (own := marked(found)) is not None]
    prose = [b.text for found in read for b in found if len(b.text) >= 40 and b.link < 0.3]
    maker = PageMaker(prose, seed)
    for _ in range(made):
        found = list(blocks(maker.page()))
        labelled.append((found, np.array([b.kept == "1" for b in found], np.float32)))
    labelled = [(f, own) for f, own in labelled if f]
    model = Labeller(seed)
    model.fit([features(f) for f, _ in labelled], [own for _, own in labelled], seed)
    return model


def main_text(found: list[list[Block]], model: Labeller | None) -> list[str]:
    """The kept blocks of each page, joined by an empty line."""
    out = [""] * len(found)
    full = sorted((i for i, f in enumerate(found) if f), key=lambda i: len(found[i]))
    # pages of similar length go together, so little is padded
    start = 0
    while start < len(full):
        stop = start + 1
        while stop < len(full) and (stop - start + 1) * len(found[full[stop]]) <= 4096:
            stop += 1
        some = full[start:stop]
        if model is None:
            kept = [np.ones(len(found[i])) if (m := marked(found[i])) is None else m for i in some]
        else:
            kept = model.probabilities([features(found[i]) for i in some])
        for i, share in zip(some, kept, strict=True):
            out[i] = "\n\n".join(b.text for b, s in zip(found[i], share, strict=True) if s >= KEEP)
        start = stop
    return out


def extract(pages: DataFrame, model: Labeller | None) -> DataFrame:
    """``(page_id, url, text, n_chars, n_blocks)`` of every page."""
    packed = pages.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = pickle.loads(packed.value)
        for batch in batches:
            for part in slices(batch, "html"):
                found = [list(blocks(h or "")) for h in part.column("html").to_pylist()]
                texts = main_text(found, loaded)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()), pa.array([len(f) for f in found], pa.int64()),
                    ],
                    ["page_id", "url", "text", "n_chars", "n_blocks"],
                )

    return rows.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long, n_blocks long")
