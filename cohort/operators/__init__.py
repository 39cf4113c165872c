"""Row selection, traversal along references, link tables, policies, and anonymizing."""
