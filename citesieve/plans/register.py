"""A pair of dictionaries and a decorator that fills them."""


def registry():
    queries: dict = {}
    oracles: dict = {}

    def register(name: str, oracle: str | None = None):
        def wrap(function):
            queries[name] = function
            if oracle:
                oracles[name] = oracle
            return function

        return wrap

    return queries, oracles, register
