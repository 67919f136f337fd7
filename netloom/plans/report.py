"""Tables of fits as text, Markdown, LaTeX and HTML, and fits on disk as JSON."""

from __future__ import annotations

import html
import json
import math

import numpy as np

from netloom.plans.pseudolikelihood import Fit

STARS = (0.001, 0.01, 0.05)


def _cell(fit: Fit, name: str, digits: int, stars: tuple) -> tuple[str, str]:
    if name not in fit.names:
        return "", ""
    k = fit.names.index(name)
    b, e = float(fit.coef[k]), float(fit.stderr[k])
    p = math.erfc(abs(b / e) / math.sqrt(2)) if e else float("nan")
    mark = "*" * sum(p < s for s in stars) if p == p else ""
    return f"{b:.{digits}f}{mark}", f"({e:.{digits}f})"


def table(*fits: Fit, names: list[str] | None = None, digits: int = 2, stars: tuple = STARS, rename: dict | None = None, omit: list[str] | None = None, style: str = "text") -> str:
    """Estimates with stars over standard errors, then AIC, BIC and log-likelihood, a column for each fit."""
    titles = names or [f"Model {k + 1}" for k in range(len(fits))]
    every = [n for n in dict.fromkeys(n for f in fits for n in f.names) if n not in (omit or [])]
    rows = []
    for n in every:
        cells = [_cell(f, n, digits, stars) for f in fits]
        rows += [[(rename or {}).get(n, n), *[c for c, _ in cells]], ["", *[e for _, e in cells]]]
    for label, value in (("AIC", lambda f: f.aic), ("BIC", lambda f: f.bic), ("Log Likelihood", lambda f: f.loglik)):
        rows.append([label, *[f"{value(f):.{digits}f}" for f in fits]])
    head = ["", *titles]
    if style == "markdown":
        line = lambda r: "| " + " | ".join(x.replace("|", "\\|").replace("*", "\\*") for x in r) + " |"
        return "\n".join([line(head), "|" + "---|" * len(head), *map(line, rows)])
    if style == "latex":
        escape = lambda x: "".join({"_": r"\_", "#": r"\#", "%": r"\%", "&": r"\&", "~": r"\textasciitilde{}", "^": r"\^{}"}.get(c, c) for c in x)
        body = " \\\\\n".join(" & ".join(map(escape, r)) for r in [head, *rows])
        return f"\\begin{{tabular}}{{l{'r' * len(fits)}}}\n\\hline\n{body} \\\\\n\\hline\n\\end{{tabular}}"
    if style == "html":
        line = lambda r, tag: "<tr>" + "".join(f"<{tag}>{html.escape(x)}</{tag}>" for x in r) + "</tr>"
        return "<table>\n" + "\n".join([line(head, "th"), *[line(r, "td") for r in rows]]) + "\n</table>"
    widths = [max(len(r[k]) for r in [head, *rows]) for k in range(len(head))]
    lines = ["  ".join([r[0].ljust(widths[0]), *[x.rjust(w) for x, w in zip(r[1:], widths[1:])]]).rstrip() for r in [head, *rows]]
    rule = "-" * max(map(len, lines))
    note = "  ".join(f"{'*' * (len(stars) - k)} p < {s:g}" for k, s in enumerate(sorted(stars)))
    return "\n".join([lines[0], rule, *lines[1:], rule, note])


def save(fit: Fit, path: str) -> None:
    with open(path, "w") as f:
        json.dump({"names": fit.names, "coef": fit.coef.tolist(), "cov": fit.cov.tolist(), "loglik": fit.loglik, "null_loglik": fit.null_loglik, "dyads": fit.dyads, "offset": fit.offset.tolist(), "exact": fit.exact}, f)


def load(path: str) -> Fit:
    with open(path) as f:
        x = json.load(f)
    return Fit(x["names"], np.array(x["coef"]), np.array(x["cov"]), x["loglik"], x["null_loglik"], x["dyads"], np.array(x["offset"], bool), x["exact"])
