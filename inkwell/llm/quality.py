"""Text quality statistics per document, and which texts are not natural prose.

A text falls into passages (runs of lines of one kind between blank lines). Each passage has a vector of statistics; a Gaussian
mixture fitted by expectation-maximization on the standardized statistics of all passages gives components, which start from the data and which inspected
examples map to prose, list, table or junk. A text is natural prose where prose passages hold at least half of its characters.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from math import log, log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import materialize

@dataclass(frozen=True)
class QualityParams:
    #: components of the mixture
    components: int = 32
    #: passages, about, of the sample on which the components start; they are then fitted on all passages
    sample: int = 20_000
    #: mean gain of log likelihood at which a fit has converged, and the most rounds until it has
    tolerance: float = 1e-3
    rounds: int = 200
    #: least variance of a standardized statistic in a component
    floor: float = 0.02
    seed: int = 7


# The commonest function words of the languages of the corpus.
COMMON = {
    "en": "a an the this that these those each every another one our my your his her its their we i you he she it they and or but so because while whereas although until unless since of in on at to for from by with without under over near next after before behind during inside instead top apart between into out up down off is are was were be been has have had not no do does did will would can could may which who what when where there here than then as if about keeps more most some any such once so far",
    "de": "der die das den dem des ein eine einer eines einem einen jede jeder jedes unser unsere mein kein und oder aber doch denn weil dass als wie wenn bis seit auf in im am an aus bei mit nach von vom zu zum zur ohne unter über für vor hinter zwischen ist sind war waren wird wurde hat haben nicht es er sie wir ich ihr sich auch nur noch schon so wo was wer",
    "fr": "le la les l un une des du de d au aux ce cette ces son sa ses notre nos mon ma chaque et ou mais donc car parce que qui quoi dont quand tandis alors puisque si comme sur sous dans en par pour avec sans près depuis pendant après avant entre vers chez jusqu est sont était a ont fait ne pas plus il elle nous vous ils elles je on se y cela sous",
    "es": "el la los las un una unos unas lo al del de este esta ese esa cada nuestro nuestra mi su sus y e o pero porque que quien cuando mientras aunque ya si como en con sin por para sobre bajo hasta desde durante después antes entre hacia junto es son era fue está ha han no ni más se le les yo ella nosotros ellos eso esto muy",
}
COMMON_WORDS = frozenset(w.encode() for words in COMMON.values() for w in words.split())
# What opens a list item.
MARKER = re.compile(r"\s*(?:[-*+•‣◦]|\d{1,3}[.)]|[a-zA-Z][.)])(?:\s|$)")
FENCE = re.compile(r"\s*(?:`{3,}|~{3,})")
HEADING = re.compile(r"#{1,6}\s")

LETTERS_ONLY = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))
NOT_DIGITS = bytes(i for i in range(256) if not 48 <= i <= 57)
SPACE_AND_LATER_BYTES = bytes([*range(9, 14), *range(28, 33), *range(128, 192)])
LATER_BYTES = bytes(range(128, 192))
FEATURES = ("common", "letters", "digits", "symbols", "word_length", "line_words", "separators", "longest_gap")

# Inspected examples: passages as they occur, with the class that a reader gives them. Fixed values.
EXAMPLES = [
    ("prose", "The old printer in the hall jams every morning, so we keep a note on the door that says which tray to use. Nobody has had the time to order another one."),
    ("prose", "We moved the backup to the second disk because the first one was full."),
    ("prose", "Der neue Drucker steht im Keller, und die alte Liste hängt noch an der Tür. Wir haben sie seit dem Umbau nicht mehr gebraucht."),
    ("prose", "La lampe du couloir est en panne depuis la semaine passée, et nous attendons une pièce pour la réparer avant la fin du mois."),
    ("prose", "El informe del taller está en la mesa de la entrada, porque nadie ha tenido tiempo de leerlo hasta ahora."),
    ("prose", "A short sentence ends the page."),
    ("list", "- flour\n- dry yeast, salt\n- oven tray: 2\n- tea towel"),
    ("list", "- [ ] call plumber\n- [ ] spare key\n- [ ] paint, brush: 3"),
    ("list", "a) lamp, cable\nb) switch\nc) fuse box: 14"),
    ("list", "- shelf 2\n- lamp, tape: 7\n- shelf 3\n- fuse, cord: 8"),
    ("table", "lamp\t14.20\t88\thall\ncable\t3.50\t7102\tcellar\nfuse\t0.80\t2026-01-04\tloft"),
    ("table", "| part | price | room |\n|---|---|---|\n| lamp | 14.20 | hall |\n| cable | | 7102 |"),
    ("table", "lamp;14.20;88;hall\ncable;3.50;7102;cellar\nfuse;0.80;;loft"),
    ("table", "lamp       14.20    88      hall\ncable      3.50     7102    cellar"),
    ("junk", "Home | Log in | Tags | Search | Print | Up\nBack | Tags | Home | Index | Search | Archive"),
    ("junk", "2026-02-03T04:05:06Z WARN lamp[4410]: rc=3 dur=912ms id=9fe12c77a0\n2026-02-03T04:06:11Z INFO cable[77]: rc=0 dur=18ms id=01be55d3c9"),
    ("junk", "4f 00 a1 9c 33 07 e5 b2 18 6d ff 21 90 4a c3 7e"),
    ("junk", "kq7ZtR0v+Yw3/8sLmNcX2bHfJpD5eGaUiO9yTrEwQzKxVnB4M6lS1PhCdFgA"),
    ("junk", "xq vj'k wzr0t p lk.gfd qqw zxc| bnm rtp hjk"),
    ("junk", "lamp cable fuse window tray printer cellar ladder bucket repair carries towel door brittle lamp"),
    ("junk", "lamp, cable, fuse, window, tray, printer, cellar, ladder, bucket, towel, door, lamp, fuse, cable, tray"),
    ("junk", "cp -r notes/ /srv/old && ./run.sh --fast\nls -l | grep tmp > out.txt\nexport MODE=1"),
    ("junk", "=-=-=-=-=-=-=-=-=-=-= lamp\n##################### fuse"),
    ("junk", "Ã¼â€™Â°Ã©nâœ Â©lÃ¤pâ€œ aÂ¼nÃ©râ€"),
]
CLASSES = ("prose", "list", "table", "junk")


def passages(text: str) -> list[tuple[str, list[str]]]:
    """Runs of lines of one kind: ``front`` matter, ``heading``, ``code``, ``item``, ``row`` or ``plain``."""
    out: list[tuple[str, list[str]]] = []
    lines = text.splitlines()
    k = 0
    while k < len(lines) and not lines[k].strip():
        k += 1
    if k < len(lines) and lines[k].rstrip() == "---":
        for end in range(k + 1, len(lines)):
            if lines[end].rstrip() == "---":
                out.append(("front", lines[k : end + 1]))
                lines = lines[end + 1 :]
                break
    fence, last = "", ""
    for line in lines:
        bare = line.lstrip()
        if not bare:
            last = ""
            continue
        if fence:
            kind = "code"
            if bare.startswith(fence):
                fence = ""
        elif bare[0] in "`~" and FENCE.match(line):
            kind, fence = "code", bare[0] * 3
        elif bare[0] == "#" and HEADING.match(bare):
            kind = "heading"
        elif "|" in line or "\t" in line:
            kind = "row"
        elif bare[0] in "-*+•‣◦>" or bare[1:2] in (".", ")") or bare[0].isdigit():
            kind = "item" if MARKER.match(line) else "plain"
        else:
            kind = "plain"
        if kind == last:
            out[-1][1].append(line)
        else:
            out.append((kind, [line]))
            last = kind
    return out


def statistics(lines: list[str]) -> tuple[int, tuple[float, ...]]:
    """Non-whitespace characters of a passage and its ``FEATURES``."""
    text = "\n".join(lines).lower()
    raw = text.encode("utf-8", "replace")
    chars = len(raw.translate(None, SPACE_AND_LATER_BYTES))
    words = raw.translate(LETTERS_ONLY).split()
    n = len(words) or 1
    joined = b"".join(words)
    letters = len(joined) if joined.isascii() else len(joined.translate(None, LATER_BYTES))
    digits = len(raw.translate(None, NOT_DIGITS))
    is_common = list(map(COMMON_WORDS.__contains__, words))
    gap = max(map(len, "".join("x" if c else " " for c in is_common).split("x")))
    total = chars or 1
    commas = raw.count(b",")
    separators = raw.count(b"|") + raw.count(b"\t") + raw.count(b";") + commas
    return chars, (
        sum(is_common) / n,
        letters / total,
        digits / total,
        max(0, chars - letters - digits - raw.count(b".") - commas) / total,
        log((letters or 1) / n),
        log1p(len(words) / len(lines)),
        min(2.0, separators / n),
        log1p(gap),
    )


def text_passages(text: str | None) -> list[tuple[int, tuple[float, ...] | None]]:
    """Characters and statistics of each passage; headings and frontmatter are no sentences and have no statistics."""
    out = []
    for kind, lines in passages(text or ""):
        chars, stats = statistics(lines)
        out.append((chars, None if kind in ("front", "heading") else stats))
    return out


class Mixture:
    """A Gaussian mixture with diagonal covariances on standardized statistics.

    It starts from a sample: centres by k-means++ and a few rounds of k-means, then expectation-maximization on the sample until that converges.
    """

    def __init__(self, center: np.ndarray, scale: np.ndarray, sample: np.ndarray, params: QualityParams):
        self.center, self.scale, self.floor = center, np.maximum(scale, 1e-6), params.floor
        self.examples = self.standard(np.array([statistics(t.split("\n"))[1] for _, t in EXAMPLES]))
        self.labels = [c for c, _ in EXAMPLES]
        self._start(self.standard(sample[np.lexsort(sample.T)].astype(np.float64)), params)
        self.rounds, self.likelihood, self.converged = 0, None, False

    def _start(self, z: np.ndarray, params: QualityParams) -> None:
        rng, distinct = np.random.default_rng(params.seed), len(np.unique(z, axis=0))
        centers = [z[rng.integers(len(z))]]
        far = ((z - centers[0]) ** 2).sum(1)
        while len(centers) < min(params.components, distinct) and far.sum() > 0:
            centers.append(z[rng.choice(len(z), p=far / far.sum())])
            far = np.minimum(far, ((z - centers[-1]) ** 2).sum(1))
        mean = np.array(centers)
        for _ in range(10):
            of = ((z * z).sum(1)[:, None] - 2 * z @ mean.T + (mean**2).sum(1)).argmin(1)
            mean = np.array([z[of == k].mean(0) if (of == k).any() else mean[k] for k in range(len(mean))])
        self.mean, self.weight = mean, np.maximum(np.bincount(of, minlength=len(mean)), 1) / len(z)
        self.weight = self.weight / self.weight.sum()
        self.var = np.array([np.maximum(z[of == k].var(0), params.floor) if (of == k).sum() > 1 else np.ones(z.shape[1]) for k in range(len(mean))])
        before = None
        for _ in range(params.rounds):
            stats, total = self._sums(z)
            self.maximize(stats)
            now = total / len(z)
            if before is not None and now - before < params.tolerance:
                break
            before = now

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x - self.center) / self.scale

    def log_densities(self, z: np.ndarray) -> np.ndarray:
        inv = 1 / self.var
        quad = (z * z) @ inv.T - 2 * z @ (self.mean * inv).T + (self.mean**2 * inv).sum(1)
        return np.log(self.weight) - 0.5 * (quad + np.log(self.var).sum(1) + z.shape[1] * np.log(2 * np.pi))

    def responsibilities(self, z: np.ndarray) -> tuple[np.ndarray, float]:
        logs = self.log_densities(z)
        top = logs.max(1, keepdims=True)
        p = np.exp(logs - top)
        total = p.sum(1, keepdims=True)
        return p / total, float((np.log(total) + top).sum())

    def expect(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Sufficient statistics of the rows: for each component weight, sums and sums of squares."""
        return self._sums(self.standard(x.astype(np.float64)))

    def _sums(self, z: np.ndarray) -> tuple[np.ndarray, float]:
        r, likelihood = self.responsibilities(z)
        return np.concatenate([r.sum(0)[:, None], r.T @ z, r.T @ (z * z)], 1), likelihood

    def maximize(self, stats: np.ndarray) -> None:
        d = self.mean.shape[1]
        n = stats[:, :1]
        alive = n[:, 0] > 1e-3
        self.mean[alive] = (stats[:, 1 : d + 1] / np.maximum(n, 1e-12))[alive]
        self.var[alive] = np.maximum(stats[:, d + 1 :] / np.maximum(n, 1e-12) - self.mean**2, self.floor)[alive]
        self.weight = np.maximum(n[:, 0], 1e-9)
        self.weight /= self.weight.sum()

    def classes(self) -> np.ndarray:
        """The class of each component: that of the example nearest to its mean."""
        near = ((self.mean[:, None] - self.examples[None]) ** 2).sum(2).argmin(1)
        return np.array([CLASSES.index(self.labels[k]) for k in near])

    def classify(self, x: np.ndarray) -> np.ndarray:
        """Probability of each class, a row each."""
        r, _ = self.responsibilities(self.standard(x.astype(np.float64)))
        of = self.classes()
        return np.stack([r[:, of == k].sum(1) for k in range(len(CLASSES))], 1)


def passage_blocks(documents: DataFrame, doc_id: str, text: str, rows: int = 2000) -> DataFrame:
    """Blocks of documents: ids, passages of each, their characters, and the statistics as one matrix of single-precision floats."""
    kind = documents.schema[doc_id].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            for k in range(0, len(batch), rows):
                part = batch.iloc[k : k + rows]
                per = [text_passages(t) for t in part["txt"]]
                stats = [s if s else (np.nan,) * len(FEATURES) for p in per for _, s in p]
                yield pd.DataFrame({
                    "ids": [part["doc"].to_numpy()], "n": [np.array([len(p) for p in per], np.int32)],
                    "chars": [np.array([c for p in per for c, _ in p], np.int32)], "stats": [np.array(stats, np.float32).tobytes()],
                })

    return documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("txt")).mapInPandas(scan, f"ids array<{kind}>, n array<int>, chars array<int>, stats binary")


def _matrix(stats: bytes) -> np.ndarray:
    return np.frombuffer(stats, np.float32).reshape(-1, len(FEATURES))


def fit(blocks: DataFrame, params: QualityParams = QualityParams()) -> Mixture | None:
    """The mixture of all passages; None if there are none. Warns if the rounds are over before it has converged.

    The sample that it starts from is drawn by document and place. Each round of expectation-maximization covers every passage: sufficient statistics are summed by task
    and a few numbers are combined on the driver.
    """

    def moments(batches):
        total = np.zeros((3, len(FEATURES)))
        for batch in batches:
            for raw in batch["stats"]:
                x = _matrix(raw).astype(np.float64)
                x = x[~np.isnan(x[:, 0])]
                total += np.stack([np.full(x.shape[1], len(x)), x.sum(0), (x * x).sum(0)])
        yield pd.DataFrame({"k": range(3), "v": list(total)})

    def summed(f, of):
        sums = blocks.select("stats").mapInPandas(f, "k int, v array<double>")
        rows = sums.groupBy("k").agg(*(F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(of))).orderBy("k").collect()
        return np.array([[r[f"v{i}"] or 0.0 for i in range(of)] for r in rows])

    d = len(FEATURES)
    totals = summed(moments, d)
    if not len(totals) or totals[0, 0] < 1:
        return None
    mean, share = totals[1] / totals[0], min(1.0, params.sample / totals[0, 0])

    def draw(batches):
        for batch in batches:
            for ids, n, raw in zip(batch["ids"], batch["n"], batch["stats"]):
                x, place = _matrix(raw), np.concatenate([[0], np.cumsum(n)])
                own = pd.util.hash_array(np.array([str(i) for i in ids], object))
                mixed = (np.repeat(own, n) + (np.arange(len(x)) - np.repeat(place[:-1], n)).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                taken = x[~np.isnan(x[:, 0]) & ((mixed >> np.uint64(32)) < np.uint64(int(share * 2**32)))]
                yield pd.DataFrame({"x": [r.tobytes() for r in taken]}).astype({"x": object})

    rows = blocks.select("ids", "n", "stats").mapInPandas(draw, "x binary").limit(2 * params.sample).collect()
    sample = _matrix(b"".join(r.x for r in rows)) if rows else mean[None].astype(np.float32)
    mixture = Mixture(mean, np.sqrt(np.maximum(totals[2] / totals[0] - mean**2, 0)), sample, params)
    for _ in range(params.rounds):

        def expect(batches, mixture=mixture):
            total, likelihood = np.zeros((len(mixture.mean), 2 * d + 1)), 0.0
            for batch in batches:
                for raw in batch["stats"]:
                    x = _matrix(raw)
                    x = x[~np.isnan(x[:, 0])]
                    if len(x):
                        s, ll = mixture.expect(x)
                        total, likelihood = total + s, likelihood + ll
            yield pd.DataFrame({"k": range(len(total) + 1), "v": [*total, np.array([likelihood] + [0.0] * 2 * d)]})

        sums = summed(expect, 2 * d + 1)
        now, before = sums[-1, 0] / totals[0, 0], mixture.likelihood
        mixture.maximize(sums[:-1])
        mixture.rounds, mixture.likelihood = mixture.rounds + 1, now
        mixture.converged = before is not None and now - before < params.tolerance
        if mixture.converged:
            break
    if params.rounds and not mixture.converged:
        warnings.warn(f"the mixture has not converged in {params.rounds} rounds (mean log likelihood {mixture.likelihood:.4f})", stacklevel=2)
    return mixture


def text_quality(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", params: QualityParams = QualityParams()) -> DataFrame:
    """Per document: ``chars`` without whitespace, shares of prose, list, table and junk among them, ``kind`` and ``is_prose``.

    Texts are read once, into blocks of passage statistics; the mixture is fitted on all of them and then applied to them.
    Headings and frontmatter count as junk. ``kind`` is the class with the largest share, prose first among equals.

    Defined cases: a null or blank text has no characters, null shares and kind and is no case, so ``is_prose`` is null; a repeated row is rated as
    often as it stands; a null id is kept; a text of any length is one row of passages; no documents give no rows.
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    blocks = materialize(passage_blocks(documents, doc_id, text), "passages")
    mixture = fit(blocks, params)

    def rate(batches):
        for batch in batches:
            for ids, n, chars, raw in zip(batch["ids"], batch["n"], batch["chars"], batch["stats"]):
                x = _matrix(raw)
                p = np.zeros((len(x), len(CLASSES)))
                ok = ~np.isnan(x[:, 0]) if len(x) else np.zeros(0, bool)
                p[:, -1] = 1
                if ok.any():
                    p[ok] = mixture.classify(x[ok])
                weight = np.eye(len(CLASSES))[p.argmax(1)] * np.asarray(chars)[:, None] if len(x) else np.zeros((0, len(CLASSES)))
                owner = np.repeat(np.arange(len(ids)), n)
                sums = np.stack([np.bincount(owner, weight[:, k], len(ids)) for k in range(len(CLASSES))], 1)
                total = sums.sum(1)
                share = sums / np.maximum(total, 1)[:, None]
                out = pd.DataFrame({"doc_id": list(ids), "chars": total.astype(np.int64)})
                for k, c in enumerate(CLASSES):
                    out[f"{c}_share"] = np.where(total > 0, share[:, k], np.nan)
                out["kind"] = [CLASSES[k] if t else None for k, t in zip(share.argmax(1), total)]
                out["is_prose"] = pd.array([bool(s >= 0.5) if t else None for s, t in zip(share[:, 0], total)], dtype="boolean")
                yield out

    rated = blocks.mapInPandas(rate, f"doc_id {kind}, chars bigint, " + ", ".join(f"{c}_share double" for c in CLASSES) + ", kind string, is_prose boolean")
    shares = [F.when(F.col("chars") > 0, F.col(f"{c}_share")).alias(f"{c}_share") for c in CLASSES]
    return rated.select("doc_id", "chars", *shares, "kind", "is_prose")


def text_measures(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Plain measures of each text, by built-in functions only: words, mean word length, symbol ratio, line ends, common words.

    Words are runs of non-whitespace. A null text has null measures; a blank one no words and null ratios.
    """
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x) != "")
    common = F.array(*(F.lit(w) for w in sorted({w for c in COMMON.values() for w in c.split()})))
    bare = lambda w: F.regexp_replace(F.lower(w), r"[.,;:!?()]", "")
    base = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), words.alias("w"), lines.alias("l"))
    n = F.nullif(F.size("w"), F.lit(0))
    chars = F.length(F.regexp_replace("t", r"\s", ""))
    return base.select(
        "doc_id",
        F.when(F.col("t").isNotNull(), F.size("w")).cast("bigint").alias("words"),
        F.round(chars / n, 6).alias("mean_word_length"),
        F.round(F.length(F.regexp_replace("t", r"[\p{L}\p{N}\s]", "")) / F.nullif(chars, F.lit(0)), 6).alias("symbol_ratio"),
        F.round(F.size(F.filter("l", lambda x: F.rtrim(x).rlike(r"[.!?:;]$"))) / F.nullif(F.size("l"), F.lit(0)), 6).alias("ended_lines"),
        F.round(F.size(F.filter("w", lambda w: F.array_contains(common, bare(w)))) / n, 6).alias("common_words"),
    )
