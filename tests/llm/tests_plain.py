SF = "/root/testdata/sf0.001"


def plain(rows):
    def one(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool):
            return v
        return round(float(v), 9) if isinstance(v, (int, float)) else v

    return sorted(repr([one(v) for v in r]) for r in rows)
