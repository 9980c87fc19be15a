"""A small project in several languages, for queries that need sources the provided tables don't hold."""

FILES = {
    "shop/__init__.py": "",
    "shop/errors.py": '"""Errors."""\n\n\nclass ShopError(Exception):\n    """Base."""\n\n\nclass EmptyCart(ShopError):\n    pass\n',
    "shop/cart.py": '"""The cart."""\nimport json\nfrom collections import deque\nfrom .errors import EmptyCart, ShopError\n\n\ndef total(prices):\n    return sum(prices)\n\n\nclass Base:\n    limit = 3\n\n    def check(self):\n        if not self.items:\n            raise EmptyCart()\n\n\nclass Cart(Base, dict):\n    """Holds items."""\n\n    @property\n    def items(self):\n        return deque()\n\n    def pay(self):\n        self.check()\n        self.print_bill()\n        return total([1, 2])\n\n    if True:\n        def print_bill(self):\n            return json.dumps({})\n\n\ndef orphan():\n    return orphan()\n',
    "tests/test_cart.py": "from shop.cart import Cart, total\n\n\ndef test_total():\n    cart = Cart()\n    cart.pay()\n    assert total([1]) == 1\n",
    "broken.py": "def f(:\n    pass\n" + "x = 1\n" * 30,
    "docs/guide.md": "Before all.\n\n# Guide\n\nStart here.\n\n## Notes\n\nFirst.\n\n```\n# no heading\n```\n\n## Notes\n\nSecond.\n\n#### Deep\n\nText.\n",
    "db/schema.sql": "\\set ON_ERROR_STOP on\n-- the orders\nCREATE TABLE orders (id int, total numeric);\nCREATE INDEX orders_total ON orders (total);\nWITH big AS (SELECT * FROM orders WHERE total > 5), top AS (SELECT id, row_number() OVER (ORDER BY total) AS n FROM big)\nSELECT * FROM top JOIN customers USING (id);\nSELECT ((1;\nINSERT INTO log SELECT 'a;b' FROM orders;\nDO $$ BEGIN PERFORM 1; END $$;\n",
    "data/catalog.xml": '<catalog xmlns:x="urn:x"><book id="b1"><title>One</title></book><book id="b2"><title>Two &amp; more</title></book></catalog>',
    "web/app.js": "import x from 'x';\nconst a = 1;\n\nfunction start() {\n  return { a };\n}\n\nexport class App {\n  run() { start(); }\n}\n\nexport const size = 3;\nexport default () => 1;\n",
    "web/site.css": "\n".join(f".c{k} {{ color: red; }}" for k in range(230)) + "\n",
    "notes/readme.txt": "A short note.\n\nOf two paragraphs.\n",
}
