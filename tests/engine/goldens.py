"""What the chunkers make of the small project of ``fixtures``: recorded, then checked line by line against its sources."""

CHUNK = "file_path, chunk_type, identity, sub_ordinal::int AS sub_ordinal, line_start::int AS line_start, line_end::int AS line_end, metadata"
CHUNK_NAMES = "file_path, chunk_type, identity, sub_ordinal, line_start, line_end, metadata"

#: By kind of file its chunks, one row a line.
CHUNKS = {
    "python_chunks": """
        ('broken.py', 'python_window', 'window#0', 0, 1, 32, '{}'),
        ('shop/cart.py', 'imports', 'imports', 0, 2, 4, '{"class_name":"","method_name":"","inherits":"","decorators":""}'),
        ('shop/cart.py', 'function', 'total', 0, 7, 8, '{"class_name":"","method_name":"total","inherits":"","decorators":""}'),
        ('shop/cart.py', 'class', 'Base', 0, 11, 12, '{"class_name":"Base","method_name":"","inherits":"","decorators":""}'),
        ('shop/cart.py', 'method', 'Base.check', 0, 14, 16, '{"class_name":"Base","method_name":"check","inherits":"","decorators":""}'),
        ('shop/cart.py', 'class', 'Cart', 0, 19, 20, '{"class_name":"Cart","method_name":"","inherits":"Base,dict","decorators":""}'),
        ('shop/cart.py', 'method', 'Cart.items', 0, 22, 24, '{"class_name":"Cart","method_name":"items","inherits":"","decorators":"property"}'),
        ('shop/cart.py', 'method', 'Cart.pay', 0, 26, 29, '{"class_name":"Cart","method_name":"pay","inherits":"","decorators":""}'),
        ('shop/cart.py', 'method', 'Cart.print_bill', 0, 32, 33, '{"class_name":"Cart","method_name":"print_bill","inherits":"","decorators":""}'),
        ('shop/cart.py', 'function', 'orphan', 0, 36, 37, '{"class_name":"","method_name":"orphan","inherits":"","decorators":""}'),
        ('shop/errors.py', 'class', 'ShopError', 0, 4, 5, '{"class_name":"ShopError","method_name":"","inherits":"Exception","decorators":""}'),
        ('shop/errors.py', 'class', 'EmptyCart', 0, 8, 9, '{"class_name":"EmptyCart","method_name":"","inherits":"ShopError","decorators":""}'),
        ('tests/test_cart.py', 'imports', 'imports', 0, 1, 1, '{"class_name":"","method_name":"","inherits":"","decorators":""}'),
        ('tests/test_cart.py', 'function', 'test_total', 0, 4, 7, '{"class_name":"","method_name":"test_total","inherits":"","decorators":""}')
    """,
    "markdown_chunks": """
        ('docs/guide.md', 'markdown_section', '(preamble)', 0, 1, 1, '{"heading_path":"","token_count":"2"}'),
        ('docs/guide.md', 'markdown_section', 'Guide', 0, 5, 5, '{"heading_path":"Guide","token_count":"2"}'),
        ('docs/guide.md', 'markdown_section', 'Guide > Notes', 0, 9, 13, '{"heading_path":"Guide > Notes","token_count":"7"}'),
        ('docs/guide.md', 'markdown_section', 'Guide > Notes#1', 0, 17, 17, '{"heading_path":"Guide > Notes","token_count":"1"}'),
        ('docs/guide.md', 'markdown_section', 'Guide > Notes > Deep', 0, 21, 21, '{"heading_path":"Guide > Notes > Deep","token_count":"1"}')
    """,
    "sql_chunks": """
        ('db/schema.sql', 'sql_statement', 'orders', 0, 2, 3, '{"statement_type":"create","referenced_tables":"orders","cte_names":"","created_object":"orders","has_window_funcs":"false","leading_comment":"the orders","dialect":"postgres"}'),
        ('db/schema.sql', 'sql_statement', 'orders_total', 0, 4, 4, '{"statement_type":"create","referenced_tables":"orders","cte_names":"","created_object":"orders_total","has_window_funcs":"false","leading_comment":"","dialect":"postgres"}'),
        ('db/schema.sql', 'sql_statement', 'stmt#3', 0, 5, 6, '{"statement_type":"with","referenced_tables":"customers,orders","cte_names":"big,top","created_object":"","has_window_funcs":"true","leading_comment":"","dialect":"postgres"}'),
        ('db/schema.sql', 'sql_statement', 'stmt#4', 0, 8, 8, '{"statement_type":"insert","referenced_tables":"log,orders","cte_names":"","created_object":"","has_window_funcs":"false","leading_comment":"","dialect":"postgres"}'),
        ('db/schema.sql', 'sql_statement', 'stmt#5', 0, 9, 9, '{"statement_type":"do","referenced_tables":"","cte_names":"","created_object":"","has_window_funcs":"false","leading_comment":"","dialect":"postgres"}')
    """,
    "xml_chunks": """
        ('data/catalog.xml', 'xml_element', 'catalog', 0, 1, 1, '{"root_tag":"catalog","element_tag":"catalog","tag_path":"catalog","depth":"0","child_count":"2","namespaces":"x=urn:x","id_attr":"","name_attr":""}')
    """,
    "js_chunks": """
        ('web/app.js', 'window', 'window#0', 0, 1, 3, '{}'),
        ('web/app.js', 'js_function', 'start', 0, 4, 6, '{}'),
        ('web/app.js', 'js_class', 'App', 0, 8, 10, '{}'),
        ('web/app.js', 'js_module', 'size', 0, 12, 12, '{}'),
        ('web/app.js', 'js_module', 'app', 0, 13, 13, '{}')
    """,
    "css_chunks": """
        ('web/site.css', 'stylesheet', 'window#0', 0, 1, 200, '{}'),
        ('web/site.css', 'stylesheet', 'window#1', 0, 161, 230, '{}')
    """,
    "text_chunks": """
        ('notes/readme.txt', 'text', 'window#0', 0, 1, 3, '{}')
    """,
}

#: The references between the Python files.
REFERENCES = """
    ('shop.cart.Base.check', 'shop.errors.EmptyCart', 'calls', true, 'live', 'shop/cart.py'),
    ('shop.cart.Cart.pay', 'shop.cart.Base.check', 'calls', true, 'live', 'shop/cart.py'),
    ('shop.cart.Cart.pay', 'shop.cart.Cart.print_bill', 'calls', true, 'live', 'shop/cart.py'),
    ('shop.cart.Cart.pay', 'shop.cart.total', 'calls', true, 'live', 'shop/cart.py'),
    ('shop.cart.orphan', 'shop.cart.orphan', 'calls', true, 'live', 'shop/cart.py'),
    ('shop.cart.total', 'sum', 'calls', false, 'live', 'shop/cart.py'),
    ('shop.cart', 'shop.cart.Base', 'defines', true, 'live', 'shop/cart.py'),
    ('shop.cart', 'shop.cart.Cart', 'defines', true, 'live', 'shop/cart.py'),
    ('shop.cart', 'shop.cart.orphan', 'defines', true, 'live', 'shop/cart.py'),
    ('shop.cart', 'shop.cart.total', 'defines', true, 'live', 'shop/cart.py'),
    ('shop.cart.Base', 'shop.cart.Base.check', 'defines', true, 'live', 'shop/cart.py'),
    ('shop.cart.Cart', 'shop.cart.Cart.items', 'defines', true, 'live', 'shop/cart.py'),
    ('shop.cart.Cart', 'shop.cart.Cart.pay', 'defines', true, 'live', 'shop/cart.py'),
    ('shop.cart.Cart', 'shop.cart.Cart.print_bill', 'defines', true, 'live', 'shop/cart.py'),
    ('shop.cart', 'shop.errors.EmptyCart', 'imports', true, 'live', 'shop/cart.py'),
    ('shop.cart', 'shop.errors.ShopError', 'imports', true, 'live', 'shop/cart.py'),
    ('shop.cart.Cart', 'dict', 'inherits', false, 'live', 'shop/cart.py'),
    ('shop.cart.Cart', 'shop.cart.Base', 'inherits', true, 'live', 'shop/cart.py'),
    ('shop.errors', 'shop.errors.EmptyCart', 'defines', true, 'live', 'shop/errors.py'),
    ('shop.errors', 'shop.errors.ShopError', 'defines', true, 'live', 'shop/errors.py'),
    ('shop.errors.EmptyCart', 'shop.errors.ShopError', 'inherits', true, 'live', 'shop/errors.py'),
    ('shop.errors.ShopError', 'Exception', 'inherits', false, 'live', 'shop/errors.py'),
    ('tests.test_cart.test_total', 'shop.cart.Cart', 'calls', true, 'live', 'tests/test_cart.py'),
    ('tests.test_cart.test_total', 'shop.cart.Cart.pay', 'calls', true, 'live', 'tests/test_cart.py'),
    ('tests.test_cart.test_total', 'shop.cart.total', 'calls', true, 'live', 'tests/test_cart.py'),
    ('tests.test_cart', 'tests.test_cart.test_total', 'defines', true, 'live', 'tests/test_cart.py'),
    ('tests.test_cart', 'shop.cart.Cart', 'imports', true, 'live', 'tests/test_cart.py'),
    ('tests.test_cart', 'shop.cart.total', 'imports', true, 'live', 'tests/test_cart.py')
"""

SQL = {kind: f"SELECT {CHUNK} FROM (VALUES {rows}) t({CHUNK_NAMES})" for kind, rows in CHUNKS.items()} | {
    "resolve_refs": f"SELECT * FROM (VALUES {REFERENCES}) t(src_qname, dst, kind, resolved, tier, file_path)",
}
