"""Office math to LaTeX."""

from __future__ import annotations

from .package import Element, attribute, local

_NAMES = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ",
    "nu": "ν", "xi": "ξ", "pi": "π", "rho": "ρ", "sigma": "σ", "varsigma": "ς", "tau": "τ", "upsilon": "υ", "phi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Upsilon": "Υ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
    "infty": "∞", "partial": "∂", "nabla": "∇", "pm": "±", "mp": "∓", "times": "×", "div": "÷", "cdot": "·", "leq": "≤", "geq": "≥", "neq": "≠", "approx": "≈", "equiv": "≡",
    "in": "∈", "notin": "∉", "subset": "⊂", "supset": "⊃", "subseteq": "⊆", "supseteq": "⊇", "cup": "∪", "cap": "∩", "land": "∧", "lor": "∨", "neg": "¬",
    "rightarrow": "→", "leftarrow": "←", "leftrightarrow": "↔", "Rightarrow": "⇒", "Leftarrow": "⇐", "Leftrightarrow": "⇔", "forall": "∀", "exists": "∃", "emptyset": "∅",
}
SYMBOLS = str.maketrans({**{char: "\\" + name for name, char in _NAMES.items()}, **dict(zip("οΑΒΕΖΗΙΚΜΝΟΡΤΧ", "oABEZHIKMNOPTX")), **{char: f"\\mathbb{{{letter}}}" for char, letter in zip("ℕℤℚℝℂ", "NZQRC")}})
_OPERATORS = dict(zip("∑∏∫∬∭", (r"\sum", r"\prod", r"\int", r"\iint", r"\iiint")))
_FUNCTIONS = frozenset("sin cos tan log ln lim exp max min".split())
_ACCENTS = {"̂": r"\hat", "̃": r"\tilde", "̄": r"\bar", "⃗": r"\vec", "̇": r"\dot"}
_SILENT = frozenset("rPr fPr radPr ctrlPr oMathParaPr degHide type rFonts i color sz szCs jc solidFill srgbClr latin".split())
_CLOSING = {"(": ")", "[": "]", "{": "}"}


def symbols(text: str) -> str:
    return text.translate(SYMBOLS)


class _Writer:
    """A radical that holds no more than an opening bracket runs on to its closing bracket."""

    def __init__(self) -> None:
        self.awaited: str | None = None

    def child(self, e: Element, name: str) -> str:
        return next((self.write(c) for c in e if local(c) == name), "")

    def setting(self, e: Element, name: str, default: str) -> str:
        found = next((c for c in e.iter() if local(c) == name), None)
        return default if found is None else attribute(found, "val") or ""

    def all(self, e: Element) -> str:
        return "".join(map(self.write, e))

    def write(self, e: Element) -> str:
        kind = local(e)
        if kind in _SILENT:
            return ""
        return getattr(self, f"_{kind}", self.all)(e)

    def _t(self, e: Element) -> str:
        text = symbols(e.text or "")
        if self.awaited and self.awaited in text:
            inside, _, outside = text.partition(self.awaited)
            self.awaited = None
            return inside + "}" + outside
        return text

    def _f(self, e: Element) -> str:
        return rf"\frac{{{self.child(e, 'num')}}}{{{self.child(e, 'den')}}}"

    def _sSup(self, e: Element) -> str:
        return f"{self.child(e, 'e')}^{{{self.child(e, 'sup')}}}"

    def _sSub(self, e: Element) -> str:
        return f"{self.child(e, 'e')}_{{{self.child(e, 'sub')}}}"

    def _sSubSup(self, e: Element) -> str:
        return f"{self.child(e, 'e')}_{{{self.child(e, 'sub')}}}^{{{self.child(e, 'sup')}}}"

    def _rad(self, e: Element) -> str:
        inner = self.child(e, "e")
        degree = self.child(e, "deg").strip()
        head = rf"\sqrt[{degree}]{{" if degree else r"\sqrt{"
        if inner.strip() in _CLOSING:
            self.awaited = _CLOSING[inner.strip()]
            return head
        return head + inner + "}"

    def _nary(self, e: Element) -> str:
        sign = self.setting(e, "chr", "∑")
        sub, sup, inner = (self.child(e, name) for name in ("sub", "sup", "e"))
        limits = (f"_{{{sub}}}" if sub.strip() else "") + (f"^{{{sup}}}" if sup.strip() else "")
        return f"{_OPERATORS.get(sign, symbols(sign))}{limits} {inner}"

    def _d(self, e: Element) -> str:
        inner = ", ".join(self.write(c) for c in e if local(c) == "e")
        return self.setting(e, "begChr", "(") + inner + self.setting(e, "endChr", ")")

    def _m(self, e: Element) -> str:
        rows = [" & ".join(self.write(c) for c in row if local(c) == "e") for row in e if local(row) == "mr"]
        return r"\begin{matrix}" + r" \\ ".join(rows) + r"\end{matrix}" if rows else self.all(e)

    def _func(self, e: Element) -> str:
        name, inner = self.child(e, "fName"), self.child(e, "e")
        return f"{chr(92) + name.strip() if name.strip() in _FUNCTIONS else name}{{{inner}}}"

    def _bar(self, e: Element) -> str:
        return rf"\overline{{{self.child(e, 'e')}}}"

    def _acc(self, e: Element) -> str:
        return f"{_ACCENTS.get(self.setting(e, 'chr', '^'), chr(92) + 'hat')}{{{self.child(e, 'e')}}}"


def to_latex(element: Element | None) -> str:
    if element is None:
        return ""
    writer = _Writer()
    text = writer.all(element)
    return text + ("}" if writer.awaited else "")


def formulas(element: Element | None) -> list[tuple[str, bool]]:
    """(LaTeX, displayed) of what is in element: the displayed ones first."""
    if element is None:
        return []
    first: list[Element] = []
    for p in element.iter():
        if local(p) == "oMathPara":
            first += [m for m in p if local(m) == "oMath"][:1]
    inline = [m for m in element.iter() if local(m) == "oMath" and not any(m is f for f in first)]
    found = [(to_latex(m), True) for m in first] + [(to_latex(m), False) for m in inline]
    return [f for f in found if f[0].strip()]
