from strandline.cli import main

main()
