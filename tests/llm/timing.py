"""Time of a function at two sizes."""

from time import process_time


def growth(run, small, large):
    """How many times longer run(large) takes than run(small): the least of three each."""

    def least(x):
        times = []
        for _ in range(3):
            t = process_time()
            run(x)
            times.append(process_time() - t)
        return min(times)

    return least(large) / max(least(small), 1e-4)
