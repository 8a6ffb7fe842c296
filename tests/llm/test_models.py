"""Learned models against plain ones: the dual solver of op3, the messages of op8."""

import itertools

import numpy as np

from regmart.llm import html, quality


def test_dual_coordinate_descent_against_projected_ascent():
    random = np.random.default_rng(4)
    n, width = 40, 25
    rows = [np.unique(random.integers(0, width, random.integers(1, 9))) for _ in range(n)]
    y = np.where(random.random(n) < 0.4, 1.0, -1.0)
    pos, neg = (np.bincount(np.concatenate([r for r, k in zip(rows, y) if k == sign]), minlength=width) for sign in (1, -1))
    r = quality.ratios(pos, neg)
    assert np.allclose(r, np.log((pos + 1) / (pos + 1).sum()) - np.log((neg + 1) / (neg + 1).sum()))
    x = np.zeros((n, width + 1))
    for i, c in enumerate(rows):
        x[i, c], x[i, -1] = r[c] / np.sqrt(len(c)), 1.0
    upper = quality.COST * np.where(y > 0, 1 / (y > 0).mean(), 1 / (y < 0).mean()) / 2
    q = (x * y[:, None]) @ (x * y[:, None]).T
    alpha, step = np.zeros(n), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(60_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, upper)
    w = (alpha * y) @ x

    def primal(weights, bias):
        return 0.5 * (weights @ weights + bias * bias) + (upper * np.maximum(0, 1 - y * (x[:, :-1] @ weights + bias))).sum()

    scaled, bias = quality.descend(rows, y, r, passes=4000)
    own = np.divide(scaled, r, out=np.zeros(width), where=r != 0)
    assert np.allclose(own, w[:-1], atol=1e-3) and abs(bias - w[-1]) < 1e-3
    few, few_bias = quality.descend(rows, y, r)
    few = np.divide(few, r, out=np.zeros(width), where=r != 0)
    assert primal(few, few_bias) < 1.05 * primal(w[:-1], w[-1])


def test_marginals_against_enumeration():
    random = np.random.default_rng(5)
    pages = ["<div><p>a</p><ul><li>b</li></ul></div><p>c", "<article><h1>x</h1><div><p>y</div></article>", "<p>one", "<div><div><div><p>deep</p></div></div><nav>z</nav></div>"]
    for page in pages:
        dom = html.parse(page)
        names = {f for found in html.features(dom) for f in found}
        for _ in range(5):
            model = html.Model({f: tuple(random.normal(0, 1, 3)) for f in names}, random.uniform(0.05, 1, (3, 3)).tolist())
            unary = [np.array(model.potential(found)) for found in html.features(dom)]
            total, content = 0.0, np.zeros(len(dom.nodes))
            for states in itertools.product(range(3), repeat=len(dom.nodes)):
                weight = np.prod([unary[i][s] for i, s in enumerate(states)]) * np.prod([model.edge[states[x.parent]][states[i]] for i, x in enumerate(dom.nodes) if i])
                total += weight
                content += weight * (np.array(states) == html.CONTENT)
            assert np.allclose(model.marginals(dom), content / total, rtol=1e-6)


def test_headers_of_the_site_go_and_those_of_the_article_stay():
    model = html.fit(html.PAGES)
    text = "Rain fell over the town for most of the day, and the river had reached the bridge by noon. People moved uphill."
    site = f"<html><body><header><h1>Forum</h1></header><main><h1>Title</h1><p>{text}</p></main><footer>x</footer></body></html>"
    own = f"<html><body><nav><a href=/>Home</a></nav><article><header><h1>Title</h1><p>By Ann</p></header><p>{text}</p></article></body></html>"
    assert html.extract(site, model) == f"Title\n\n{text}" and html.extract(own, model) == f"Title\n\nBy Ann\n\n{text}"
