"""Labelled blocks of invented pages of varied layout, for the decision tree of html_text.

A page is a run of lines, one block each in page order: + for main text or - for the rest, where it stands (plain, or
of box, named, content, article and h for a heading, joined by dots), its words, its words within links, and of its
form s (ends like a sentence), | (holds a separator such as a bar or a copyright sign) and t (speaks of comments).
"""

LABELLED_PAGES = """
# news page with elements that say what they are
- box 1 1
- box 1 1
- box 4 0
- box 22 0 s
+ article.h 9 0
+ article 4 0
+ article 45 0 s
+ article 2 0 s
+ article 60 4 s
- article.box 3 3
- article.box 14 2 s
+ article.h 4 0
+ article 1 0 s
+ article 80 0 s
- article.box 6 0
- box 5 2 |
- box 3 3

# article of short blocks
- box 2 2
- named 8 0 s
+ article.h 12 0
+ article 1 0 s
+ article 2 0 s
+ article 1 0
+ article 3 0 s
+ article 6 0
- box 9 0 s |

# article with a list and links
- box 3 3
+ article.h 5 0
+ article 30 12 s
+ article 4 4
+ article 7 0
+ article 2 2
+ article 6 3
+ article 25 0 s
+ article 1 1
+ article 33 0 s
- box 2 2

# article that ends in runs of links
- box 1 1
- box 2 2
+ article.h 6 0
+ article 70 3 s
+ article 41 0 s
- article 1 1
- article 2 2
- article 1 1
- article 2 2
- box 4 0 |

# article whose last blocks are short
- named 25 0 s
+ article.h 3 0
+ article 5 0 |
+ article 90 0 s
+ article 1 0
+ article 3 0 s
- named 6 1
- named 11 0 s
- box 30 30

# adverts and notices by name around and within an article
- named 16 0 s
- named 3 1
+ article.h 8 0
+ article 55 0 s
- article.named 12 0 s
+ article 48 0 s
- article.named 7 7
- article.named 2 0
+ article 20 0 s
- named 28 2 s
- named 40 0 s

# reader comments behind an article
+ article.h 7 0
+ article 100 0 s
+ article 64 0 s
- box.h 2 0
- box 35 0 s
- box 70 0 s
- box 1 1
- box 52 0 s
- article.box 44 0 s
- article.box 3 0

# blog with a named column
- plain 2 2
- plain 1 1
- plain 1 1
+ content.h 6 0
+ content 4 0
+ content 75 2 s
+ content 3 0 s
+ content 5 0
+ content 6 0
+ content 50 0 s
+ content 9 0
- content 1 1
- content 2 2
- content 1 1
- named 3 0
- named 2 2
- named 18 6 s
- plain 4 0 |

# named column, links among prose
- box 1 1
+ content.h 4 0
+ content 30 0 s
+ content 3 3
+ content 28 8 s
+ content.h 2 0
+ content 1 0 s
+ content 44 0 s
+ content 5 0 s
- content 7 7
- content 5 5
- box 6 2 |

# named column that is short
- box 2 2
- box 1 1
+ content.h 3 0
+ content 9 0 s
+ content 2 0
- box 3 0 |

# named column with a run of teasers
+ content.h 5 0
+ content 66 0 s
+ content 58 0 s
- content 6 6
- content 8 8
- content 7 7
- content 2 2
- named 12 12

# named sidebar of long texts beside links
+ plain.h 6 0
+ plain 70 0 s
+ plain 44 0 s
- named 3 3
- named 40 2 s
- named 4 4
- named 35 2 s
- named 30 10 s
- plain 1 1

# no names at all: menu, prose, end
- plain 1 1
- plain 1 1
- plain 2 2
- plain 1 1
+ plain.h 7 0
+ plain 40 0 s
+ plain 35 3 s
+ plain 62 0 s
- plain 2 2
- plain 1 1
- plain 5 0 |

# no names, title line of the site, byline
- plain 4 0
- plain 1 1
- plain 3 3
- plain 1 1
+ plain.h 8 0
+ plain 4 0
+ plain 90 0 s
+ plain.h 3 0
+ plain 33 0 s
+ plain 4 0 s
- plain 6 1 |
- plain 1 1

# no names, prose only
+ plain 22 0 s
+ plain 31 0 s
+ plain 18 0 s

# one block
+ plain 40 0 s

# one short sentence
+ plain 6 0 s

# two words
+ plain 2 0

# heading and a line
+ plain.h 2 0
+ plain 8 0 s

# heading and prose
+ plain.h 4 0
+ plain 28 0 s
+ plain 3 0 s

# links only
- plain 1 1
- plain 2 2
- plain 4 4
- plain 1 1

# one link
- plain 3 3

# a link between prose
+ plain 44 0 s
+ plain 38 0 s
- plain 6 6
+ plain 29 0 s
+ plain 51 14 s
- plain 3 3
- plain 2 2

# recipe: lists between prose
- plain 1 1
- plain 1 1
+ plain.h 3 0
+ plain 25 0 s
+ plain.h 1 0
+ plain 3 0
+ plain 2 0
+ plain 4 0
+ plain 1 0
+ plain.h 1 0
+ plain 16 0 s
+ plain 14 0 s
+ plain 5 0 s
- plain 1 1
- plain 2 2
- plain 3 0 |

# dialogue: short sentences between and behind prose
- plain 2 2
- plain 1 1
+ plain.h 5 0
+ plain 48 0 s
+ plain 3 0 s
+ plain 2 0 s
+ plain 6 0 s
+ plain 21 0 s
+ plain 4 0 s
+ plain 1 0 s
- plain 1 1
- plain 1 1
- plain 4 0 |

# list behind the prose
- plain 1 1
- plain 2 2
+ plain.h 4 0
+ plain 37 0 s
+ plain 5 0
+ plain 6 0
+ plain 4 0
+ plain 7 0
- plain 1 1
- plain 1 1

# path of the page, before the heading
- plain 5 4 |
- plain 4 3 |
+ plain.h 6 0
+ plain 55 0 s
+ plain 47 2 s
- plain 8 0 |
- plain 3 3
- plain 2 0

# lines of a menu in one block, and of an end in one block
- plain 9 9
- plain 6 0
+ plain.h 5 0
+ plain 66 5 s
+ plain 71 0 s
- plain 14 13 |
- plain 12 0 s |

# link farm and related links
- plain 12 12
+ plain.h 7 0
+ plain 39 1 s
+ plain 58 9 s
- plain.h 2 0
- plain 8 8
- plain 9 9
- plain 7 7
- plain 40 36
- plain 1 0

# headings of side columns among links
- plain.h 1 0
- plain 2 2
- plain 1 1
- plain.h 2 0
- plain 3 3
- plain 4 4
+ plain.h 6 0
+ plain 61 0 s
+ plain 35 0 s
- plain.h 2 0
- plain 2 2
- plain 3 3

# short labels between links before and behind
- plain 1 0
- plain 1 1
- plain 2 0
- plain 1 1
+ plain.h 9 0
+ plain 120 6 s
+ plain 88 0 s
- plain 2 0
- plain 1 1
- plain 1 0
- plain 2 2

# glossary with linked words
+ plain.h 2 0
+ plain 24 6 s
+ plain 30 8 s
+ plain 19 5 s
+ plain 41 10 s
- plain 2 2
- plain 2 2

# form fields and a search box
- box 1 0
- box 2 0
- box 3 0
+ plain.h 4 0
+ plain 34 0 s
+ plain 29 0 s
- box 2 0
- box 16 0 s
- box 1 1

# furniture by element only, prose without a home
- box 3 3
- box 6 0
- box 18 0 s
+ plain.h 5 0
+ plain 3 0
+ plain 42 0 s
+ plain 8 0 s
+ plain 36 0 s
+ plain 9 0
- box 26 3 s
- box 5 0 |

# short text among furniture
- box 1 1
- box 2 2
+ plain 7 0 s
+ plain 5 0
- box 4 0 |

# pages that are furniture only
- box 3 0
- box 20 0 s
- named 15 0 s

# article of separators, quotations and single words
- box 1 1
- box 7 6 |
+ article.h 1 0
+ article 6 0 |
+ article 3 0 |
+ article 50 0 s |
+ article 2 0 |
+ article 1 0
+ article 1 0
+ article 14 0 |
- box 8 0 |

# article without anything around it
+ article 1 0
+ article 2 0 |
+ article 9 2
+ article 1 0
+ article.h 2 0
+ article 1 0 s

# article between single links
- plain 1 1
+ article 1 0
+ article 2 0
+ article 1 0
+ article 3 1 |
+ article 2 0
- plain 1 1
- plain 3 0 |

# article of one block
- plain 2 2
+ article 3 0
- plain 2 2

# article with a table of single words and linked cells
+ article.h 5 0
+ article 1 0
+ article 1 1
+ article 2 0
+ article 1 0
+ article 2 2
+ article 1 0 |
+ article 40 0 s

# long texts of furniture
- box 130 0 s
- box 2 0
- box 95 3 s
+ article.h 6 0
+ article 140 0 s
+ article 88 0 s
- article.box 150 0 s
- article.box 90 0 s
+ article 110 2 s
- box 120 0 s
- box 105 0 s
- box 210 0 s
- box 84 1 s
- box 99 0 s

# comments behind prose without a home
+ plain.h 5 0
+ plain 160 0 s
+ plain 92 0 s
- box.h 1 0
- box 115 0 s
- box 30 0 s
- box 140 0 s
- box 8 0 s
- box 88 0 s

# named furniture of longer text at the edges
- named 82 0 s
+ plain.h 6 0
+ plain 100 0 s
+ plain 34 0 s
- named 85 4 s
- named 2 2
- named 90 0 s

# one word at the start and the end
+ plain 1 0 s
+ plain 60 0 s
+ plain 25 0 s
+ plain 1 0 s

# hymn: short lines
+ plain.h 3 0
+ plain 5 0
+ plain 6 0
+ plain 4 0 s
+ plain 5 0
+ plain 7 0
+ plain 3 0 s
- plain 1 1
- plain 2 2

# menu, then one block of prose, and no end
- plain 1 1
- plain 2 2
+ plain 40 0 s

# menu, then a short text, and no end
- plain 3 3
- plain 1 1
+ plain.h 4 0
+ plain 7 0 s

# menu, then short prose
- plain 2 2
- plain 4 4
+ plain 13 0 s
- plain 1 1

# menu and prose, again
- plain 1 1
- plain 1 1
+ plain 25 2 s
+ plain 90 0 s

# article at the end of the page
- plain 1 1
- plain 2 2
+ article 1 0
+ article 3 0

# article of one line at the end
- plain 2 2
+ article 2 0 s

# article, words between links and last word
- plain 5 5
+ article 2 0
+ article 3 3
+ article 1 0
+ article 4 4
+ article 1 0

# labels of a menu
- plain 1 0
- plain 1 1
- plain 1 0
- plain 2 2
- plain 4 0
- plain 3 3
+ plain.h 6 0
+ plain 50 0 s
- plain 3 0
- plain 2 2
- plain 2 0
- plain 5 5

# words that stand alone among links behind the prose
+ plain.h 3 0
+ plain 70 0 s
+ plain 66 0 s
- plain 1 1
- plain 3 0
- plain 2 2
- plain 4 0
- plain 1 1

# articles whose last line ends the page
+ article.h 5 0
+ article 40 0 s
+ article 30 0
+ article 6 0 |

# the same, in short lines
- plain 2 2
+ article.h 9 0
+ article 28 0 s
+ article 7 0 |
+ article 8 0

# the same, in a named column
+ content.h 4 0
+ content 36 0 s
+ content 33 0 s
+ content 6 0

# copyright lines right behind the prose
- plain 1 1
- plain 2 2
+ plain.h 5 0
+ plain 44 0 s
+ plain 61 0 s
- plain 5 0 s |

# the same, without a menu
+ plain 33 0 s
+ plain 27 0 s
+ plain 58 0 s
- plain 4 0 |

# the same, behind a short line
+ plain.h 3 0
+ plain 52 0 s
+ plain 2 0 s
- plain 6 0 |

# the same, in a named column
+ content.h 6 0
+ content 71 0 s
+ content 30 0 s
- plain 7 1 s |

# prose that holds separators
- plain 1 1
- plain 2 2
+ plain.h 4 0 |
+ plain 40 0 s |
+ plain 25 1 s |
+ plain 60 0 s
+ plain 19 0 s |
- plain 3 1 |

# prose that holds separators, in a named column
+ content.h 7 0 |
+ content 30 0 s |
+ content 90 2 s |
+ content 5 0 s
- content 2 2
- content 4 0 |

# unnamed comments behind an article
- box 1 1
- box 2 2
+ article.h 6 0
+ article 50 0 s
+ article 40 2 s
+ article 22 0 s
- plain.h 2 0 t
- plain 30 0 s
- plain 2 1
- plain 55 0 s
- plain 14 0 s
- plain 1 1
- box 4 0 |

# unnamed comments behind an article, no heading of their own
- box 3 3
+ article.h 5 0
+ article 34 0 s
+ article 61 0 s
- plain 3 1
- plain 25 0 s
- plain 3 1
- plain 41 0 s
- plain 2 0

# unnamed comments inside an article
+ article.h 5 0
+ article 34 0 s
+ article 61 0 s
+ article.h 3 0
+ article 28 0 s
- article.h 2 0 t
- article 31 0 s
- article 2 1
- article 18 0 s

# unnamed comments on a page without an article element
- plain 2 2
- plain 1 1
+ plain.h 6 0
+ plain 60 0 s
+ plain 35 0 s
+ plain 48 4 s
- plain.h 2 0 t
- plain 30 0 s
- plain 2 0
- plain 44 0 s
- plain 12 0 s

# comments behind a content box
- box 2 2
+ plain.h 7 0
+ content 50 0 s
+ content 40 0 s
+ content 4 0
+ content 27 0 s
- plain.h 2 0 t
- plain 35 0 s
- plain 21 0 s
- plain 3 0 |

# heading above the content box, other stories below
- plain 1 1
- plain 2 2
+ plain.h 7 0
+ content 50 0 s
+ content 31 0 s
+ content 64 3 s
- plain.h 2 0
- plain 6 6
- plain 5 5
- plain 7 7
- plain 5 0 |

# what else to read at the end of an article
- box 1 1
+ article.h 8 0
+ article 44 0 s
+ article 52 0 s
- article.h 2 0
- article 3 3
- article 2 2
- article 4 4

# article among paragraphs that lead elsewhere
+ article.h 8 0
+ article 30 0 s
+ article 6 4
+ article 30 0 s
+ article 9 6 s
+ article 25 0 s
+ article 5 3
+ article 16 0 s

# plain page with paragraphs that lead elsewhere
- plain 1 1
- plain 1 1
- plain 2 2
+ plain.h 5 0
+ plain 30 0 s
+ plain 6 4
+ plain 30 0 s
+ plain 33 0 s
+ plain 12 6 s
+ plain 40 0 s
- plain 1 1
- plain 2 2
- plain 3 0 |

# a post beside the article element
- box 2 2
+ article 9 0
+ article 40 0 s
+ article 33 0 s
+ content 31 0 s
+ content 25 0 s

# steps of an article that are links
- box 1 1
+ article.h 5 0
+ article 20 0 s
+ article 3 3
+ article.h 2 0
+ article 24 0 s
+ article 2 2
+ article 4 4
+ article 3 0
+ article 31 0 s

# subheads before short lines
- box 2 2
+ article.h 5 0
+ article 30 0 s
+ article.h 2 0
+ article 3 0 s
+ article 28 0 s
+ article.h 1 0
+ article 2 0
+ article.h 3 0
+ article 40 0 s
"""
