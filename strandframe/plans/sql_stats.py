"""The same tail probabilities as SQL text, by positive-term series."""


def erf(x: str) -> str:
    """erf(x) for x >= 0."""
    return (
        f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 6 THEN 1.0 WHEN {x} = 0 THEN 0.0 ELSE 2/sqrt(pi())*exp(-({x})*({x}))"
        f"*list_sum(list_transform(range(0,160), lambda n: exp(2*n*ln(2.0)+(2*n+1)*ln({x})+lgamma(n+1)-lgamma(2*n+2)))) END)"
    )


def normal_p(z: str) -> str:
    return f"(1 - {erf(f'(abs({z})/sqrt(2.0))')})"


def chi2_p(x: str) -> str:
    return f"(1 - {erf(f'sqrt(({x})/2.0)')})"


def _series(x: str, a: str, b: str) -> str:
    return (
        f"exp(({a})*ln({x})+({b})*ln(1-({x}))-ln({a})-(lgamma({a})+lgamma({b})-lgamma(({a})+({b}))))"
        f"*(1+list_sum(list_transform(range(0,1000), lambda n: exp((lgamma(({a})+1)+lgamma(n+1)-lgamma(({a})+n+2))"
        f"-(lgamma(({a})+({b}))+lgamma(n+1)-lgamma(({a})+({b})+n+1))+(n+1)*ln({x})))))"
    )


def beta(x: str, a: str, b: str) -> str:
    """Regularised incomplete beta I_x(a, b).

    The series in x takes its thousand terms up to x = 0.97. Beyond, with a large ``a``, it is taken in 1 - x, which needs about
    a (1 - x) terms; where those were over 300 the value is under 1e-100.
    """
    direct = f"{x} < (({a})+1)/(({a})+({b})+2) AND ({x} < 0.97 OR ({a})*(1-({x})) > 300)"
    return (
        f"(CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 WHEN {direct} THEN {_series(x, a, b)} "
        f"ELSE 1 - {_series(f'(1-({x}))', b, a)} END)"
    )


def student_p(t: str, df: str) -> str:
    return beta(f"(({df})/(({df})+({t})*({t})))", f"(({df})/2)", "0.5")


def f_p(f: str, d1: str, d2: str) -> str:
    return beta(f"(({d2})/(({d2})+({d1})*({f})))", f"(({d2})/2.0)", f"(({d1})/2.0)")


def hypergeometric_p(k: str, hits: str, drawn: str, total: str) -> str:
    def choose(n, r):
        return f"lgamma(({n})+1)-lgamma(({r})+1)-lgamma(({n})-({r})+1)"

    return (
        f"list_sum(list_transform(range(CAST({k} AS BIGINT), CAST(least({hits}, {drawn}) AS BIGINT) + 1), lambda i: exp("
        f"{choose(hits, 'i')}+{choose(f'({total})-({hits})', f'({drawn})-i')}-({choose(total, drawn)}))))"
    )
