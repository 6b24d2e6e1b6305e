from tidewheel.plans.lint import lint


def test_lint():
    source = """
def flow(ctx, value):
    t = datetime.datetime.now()
    x = random.random()
    y = ctx.side_effect(lambda: random.random())
    threading.Thread(target=print)
    return ctx.clock(), time.time
"""
    assert [line for line, _ in lint(source)] == [3, 4, 6]
    assert lint("def flow(ctx, v):\n    return ctx.execute('a', v)") == []
